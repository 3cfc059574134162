"""The queries of this subpackage, by name; each takes (spark, folder of the tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from groundwork.llm import cuts, looks, mix, neardup, pairs, pieces, scans, sentences, tokens
from groundwork.llm.common import table


def over(names: str, made: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query that gives the named tables to an operator."""
    return lambda spark, folder: made(*(table(spark, folder, n) for n in names.split()))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": over("source_blocks generation_concepts", looks.same_look),
    "p1_texts": over("source_blocks generation_concepts", looks.corpus_in_one_form),
    "p1_classes": over("source_blocks generation_concepts", looks.look_classes),
    "p2_found": over("section_scopes split_limits", pieces.oversized),
    "p2_pieces": over("section_scopes split_limits", pieces.split_scopes),
    "p3_found": over("chat_responses generation_concepts source_blocks", cuts.cut_records),
    "p3_rates": over("chat_responses generation_concepts source_blocks", cuts.cut_rates),
    "p4_found": over("cards", pairs.defective_pairs),
    "p5_found": over("cards", neardup.near_copies),
    "p5_classes": over("cards", neardup.near_copy_classes),
    "p5_groups": over("cards", neardup.near_copy_groups),
    "p6_found": over("source_blocks", scans.scan_noise),
    "p6_text": over("source_blocks", scans.repaired_pages),
    "p7_ids": over("documents", tokens.encode_corpus),
    "p8_mix": over("documents mix_targets", lambda d, t: mix.mix_sources(d, t)[0]),
    "p8_shares": over("documents mix_targets", lambda d, t: mix.mix_sources(d, t)[1]),
    "p9_found": over("documents", lambda d: sentences.split_documents(d, with_text=False).drop("sentence")),
    "p9_sentences": over("documents", sentences.split_documents),
}
