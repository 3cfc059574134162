import random

import pytest

from groundwork.llm import mix, tokens
from groundwork.llm.common import TOKENIZER_DIR

TEXTS = ["", " ", "a", "Hello, world!", "don't 'S stop", "x" * 5000, "\n" * 900 + " z", "Ünï©ødé 水闸 шлюз 👩‍🔬", "<|endoftext|> in text", None, "tab\tand space", "12 345,6 7"]


def reference(text):
    t = pytest.importorskip("tokenizers").Tokenizer.from_file(f"{TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_public_library_and_decode_to_the_text(spark):
    rng = random.Random(7)
    words = ["the", "pressure", "Köln", "水", "42", "  ", "\n", "naïve", "(see", "…", "abcdefghij" * 20]
    texts = TEXTS + ["".join(rng.choice(words) + rng.choice([" ", "", "\n"]) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in tokens.encode_corpus(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == (None if t is None else reference(t))


def test_short_and_long_words_agree():
    e = tokens.encoder(f"{TOKENIZER_DIR}/byte_bpe_50k.json")
    rng = random.Random(3)
    for n in range(2, 90):
        word = "".join(rng.choice("aaabcdeé水 ") for _ in range(n)).encode()[:90]
        short = e.encode_short(e.byte_ids[list(word)].reshape(1, -1))[0]
        assert short.tolist() == e.encode_long(word).tolist()


def test_empty_table_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.encode_corpus(none).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")
    assert [r.ids for r in tokens.encode_corpus(twice).collect()] == [[64, 275], [64, 275]]


def documents(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        source = rng.choices(["big", "small", "other", None], [400, 60, 100, 40])[0]
        rows.append((i, " ".join(["word"] * rng.randint(1, 30)), source, 5))
    rows += [(1000, None, "big", 0), (1001, "", "small", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens int")


def test_mix_meets_shares_and_repeats(spark):
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.3, 3), ("absent", 0.0, 2)], "source string, target_share double, max_repeats int")
    picked, report = mix.mix_sources(documents(spark), targets)
    rows, told = picked.collect(), {r.source: r for r in report.collect()}
    total = sum(r.n_tokens * r.times for r in rows)
    longest = max(r.n_tokens for r in rows)
    assert len({r.doc_id for r in rows}) == len(rows) and {r.source for r in rows} == {"big", "small"}
    for source, share, most in (("big", 0.7, 1), ("small", 0.3, 3)):
        mine = [r for r in rows if r.source == source]
        reached = sum(r.n_tokens * r.times for r in mine)
        assert max(r.times for r in mine) <= most
        assert abs(reached - share * total) <= 2 * longest
        assert told[source].reached_tokens == reached and told[source].documents == len(mine)
        assert told[source].reached_share == pytest.approx(reached / total)
    assert told["absent"].reached_tokens == 0


def test_mix_equals_a_plain_running_sum(spark):
    targets = spark.createDataFrame([("big", 1.0, 1)], "source string, target_share double, max_repeats int")
    docs = documents(spark)
    picked, _ = mix.mix_sources(docs, targets, total_tokens=1500)
    keys = {r.doc_id: (r.k, r.source, r.text) for r in docs.selectExpr("doc_id", "source", "text", "xxhash64(doc_id, 8) as k").collect()}
    run, want = 0, set()
    for doc, (_, _, text) in sorted(((d, v) for d, v in keys.items() if v[1] == "big" and v[2]), key=lambda x: (x[1][0], x[0])):
        n = len(reference(text))
        run += n
        if run - n / 2 <= 1500:
            want.add(doc)
    assert {r.doc_id for r in picked.collect()} == want


def test_mix_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 1.0, 1)], "source string, target_share double, max_repeats int")
    picked, report = mix.mix_sources(none, targets)
    assert picked.count() == 0 and [r.reached_share for r in report.collect()] == [0.0]
    assert mix.mix_sources(documents(spark), targets.limit(0))[0].count() == 0
