"""Problem 7: the ids of every text in a byte-level BPE vocabulary.

A text is cut by the vocabulary's public pattern into words. The words of an Arrow batch that are new are encoded
together: words of one byte length lie in one matrix of contiguous part boundaries (the ids of the parts) beside a
matrix of the ranks of adjacent parts. A step takes each row's least rank, deletes the boundary behind it by shifting
the row's tail, and refreshes the two neighbouring ranks; rows without a mergeable pair leave the matrix. Words too
long for that (``LONG`` bytes) hold their parts in a linked list with a heap of ranks instead, which gives the same
ids in n log n.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import TOKENIZER_DIR

#: Fixed value: the published pattern of the vocabulary, which splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: From so many bytes on a word counts as long.
LONG = 96
#: So many words stay known in a worker; then it starts anew.
KNOWN = 400_000
NO_RANK = np.iinfo(np.int64).max

_LOADED: dict[str, "Encoder"] = {}


def byte_letters() -> dict[str, int]:
    """The published rule by which such vocabularies write bytes: printable ones as themselves, the rest from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        letters[chr(256 + n)] = b
    return letters


class Encoder:
    """The ids of words and texts; ``pairs`` maps two adjacent ids to the rank of their merge and the id that results."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary = model["vocab"]
        self.byte_ids = np.zeros(256, np.int64)
        for letter, b in byte_letters().items():
            self.byte_ids[b] = vocabulary[letter]
        keys, merged = [], []
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            keys.append(vocabulary[left] << 32 | vocabulary[right])
            merged.append(vocabulary[left + right])
        self.rank = {k: n for n, k in reversed(list(enumerate(keys)))}
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.ranks, self.merged = np.array(keys, np.int64)[order], order.astype(np.int64), np.array(merged, np.int64)
        self.words: dict[str, np.ndarray] = {}
        self.split = regex.compile(PATTERN).findall

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NO_RANK where they don't merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NO_RANK)

    def encode_short(self, parts: np.ndarray) -> list[np.ndarray]:
        """The ids of words of one length; ``parts`` holds a word's bytes as ids in each row."""
        out: list[np.ndarray] = [np.empty(0)] * len(parts)
        row = np.arange(len(parts))
        parts = np.concatenate([parts, np.full((len(parts), 1), -1)], axis=1)
        ranks = self.look_up(parts[:, :-1], parts[:, 1:])
        while len(row):
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(row)), at]
            ended = least == NO_RANK
            if ended.any():
                for r, p in zip(row[ended], parts[ended]):
                    out[r] = p[p >= 0].astype(np.int32)
                row, parts, ranks, at, least = (x[~ended] for x in (row, parts, ranks, at, least))
                if not len(row):
                    break
            every = np.arange(len(row))
            parts[every, at] = self.merged[least]
            column = np.arange(parts.shape[1])[None, :]
            source = np.minimum(column + (column > at[:, None]), parts.shape[1] - 1)
            parts = np.take_along_axis(parts, source, axis=1)
            parts[:, -1] = -1
            parts = parts[:, :-1] if parts.shape[1] > 2 else parts
            width = parts.shape[1] - 1
            ranks = np.take_along_axis(ranks, np.minimum(source[:, :width], ranks.shape[1] - 1), axis=1)
            for near in (at - 1, at):
                has = (near >= 0) & (near < width)
                ranks[every[has], near[has]] = self.look_up(parts[every[has], near[has]], parts[every[has], near[has] + 1])
        return out

    def encode_long(self, word: bytes) -> np.ndarray:
        ids = [int(self.byte_ids[b]) for b in word]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        rank, heap = self.rank, []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(ids) and (r := rank.get(ids[i] << 32 | ids[after[i]])) is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[after[i]]))

        for i in range(len(ids)):
            offer(i)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= len(ids) or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = int(self.merged[r]), -1, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return np.array([x for x in ids if x >= 0], np.int32)

    def learn(self, words: set[str]) -> None:
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            raw = word.encode("utf-8", "surrogatepass")
            if len(raw) >= LONG:
                self.words[word] = self.encode_long(raw)
            else:
                by_length.setdefault(len(raw), []).append((word, raw))
        for length, some in by_length.items():
            parts = self.byte_ids[np.frombuffer(b"".join(raw for _, raw in some), np.uint8)].reshape(len(some), length)
            for (word, _), ids in zip(some, self.encode_short(parts)):
                self.words[word] = ids

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """The ids of each text, an empty array for an empty text, None for None."""
        split = [None if t is None else self.split(t) for t in texts]
        new = {w for words in split if words for w in words}
        if len(self.words) > KNOWN:
            self.words.clear()
        known = self.words
        new.difference_update(known.keys())
        if new:
            self.learn(new)
        nothing = np.empty(0, np.int32)
        return [None if words is None else np.concatenate([known[w] for w in words]) if words else nothing for words in split]


def encoder(path: str) -> Encoder:
    """The encoder of the vocabulary file at ``path``; a Python worker reads it once, where the node hasn't the file the one that was sent."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))
    return _LOADED[path]


def sent(documents: DataFrame, folder: str, vocabulary: str) -> str:
    """The path of a vocabulary file, which Spark sends to every node: a few megabytes whatever the data."""
    path = os.path.join(folder, f"{vocabulary}.json")
    documents.sparkSession.sparkContext.addFile(path)
    return path


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """One row (key, ids) for each row: the ids of ``text``, no special tokens.

    Null text gives null, empty text an empty list; a special token's string within a text is ordinary text. Repeated
    rows come out as often as they went in; other columns, whatever their names, are dropped. No shuffle.
    """
    kind = documents.schema[key].dataType.simpleString()
    path = sent(documents, folder, vocabulary)

    def ids_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        for batch in batches:
            texts = [None if t is None else t for t in batch["text"]]
            yield pd.DataFrame({key: batch["key"], "ids": pd.Series(e.encode(texts), dtype=object)})

    picked = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return picked.mapInPandas(ids_of, f"`{key}` {kind}, ids array<int>")


def count_tokens(documents: DataFrame, keep: list[str], text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` of each row: the number of ids of its text, 0 for empty text, null for null."""
    path = sent(documents, folder, vocabulary)
    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        for batch in batches:
            n = [None if x is None else len(x) for x in e.encode([None if t is None else t for t in batch["_text"]])]
            yield batch[keep].assign(n_tokens=pd.array(n, "Int64"))

    return documents.select(*keep, F.col(text).cast("string").alias("_text")).mapInPandas(counted, f"{kinds}, n_tokens bigint")
