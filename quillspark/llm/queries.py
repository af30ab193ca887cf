"""Queries of this package over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import canonical, language, leakage, linkage, mixing, mojibake, residue, sql
from quillspark.session import table


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = linkage.featured(table(spark, sf_dir, "records_la"), "record_id", "law_name", "law_number_ref", "source_url", notes="notes")
    entries = linkage.featured(table(spark, sf_dir, "baseline_la"), "baseline_id", "law_name", "law_number_ref", "source_url", date="law_date")
    return linkage.link(records, entries)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and baseline entries of the same instrument."""
    return _linked(spark, sf_dir).selectExpr("entry_id AS baseline_id", "record_id")


def p1_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs with their confidence."""
    return _linked(spark, sf_dir).selectExpr("entry_id AS baseline_id", "record_id", "confidence")


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, language.Model]:
    la = table(spark, sf_dir, "records_la").selectExpr("'records_la' AS tbl", "record_id AS row_id", "verbatim_snippet AS text", "language_of_source AS label")
    tl = table(spark, sf_dir, "gloss_tl").selectExpr("'gloss_tl' AS tbl", "gloss_id AS row_id", "original AS text", "language_of_source AS label")
    both = la.unionByName(tl)
    known = language.labelled_sample(both, "text", "label")
    return both, language.fit([t for t, _ in known], [c for _, c in known])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of the texts whose label doesn't state them."""
    both, model = _labelled(spark, sf_dir)
    return language.mislabelled(language.languages(both, ["tbl", "row_id"], "text", "label", model), ["tbl", "row_id"])


def p2_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of every text, its main language and a confidence."""
    both, model = _labelled(spark, sf_dir)
    return language.languages(both, ["tbl", "row_id"], "text", "label", model)


def p2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of text in one language, with a confidence."""
    both, model = _labelled(spark, sf_dir)
    return language.segments(both, ["tbl", "row_id"], "text", model)


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All snippets of records_la and records_cn: tbl, record_id, text."""
    la = table(spark, sf_dir, "records_la").selectExpr("'records_la' AS tbl", "record_id", "verbatim_snippet AS text")
    cn = table(spark, sf_dir, "records_cn").select(F.explode("provisions").alias("p")).selectExpr("'records_cn' AS tbl", "p.record_id", "p.verbatim_snippet AS text")
    return la.unionByName(cn)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of snippets that look the same and are different strings."""
    return canonical.look_alike_pairs(snippets(spark, sf_dir), "tbl", "record_id", "text").selectExpr("source AS tbl", "id_a", "id_b")


def p4_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every snippet in its consistent form."""
    rid = F.concat_ws("|", F.col("tbl"), F.col("record_id").cast("string"))
    return canonical.canonical(snippets(spark, sf_dir), "text", "canonical", rid).select("tbl", "record_id", "canonical")


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of snippets that look the same, for every snippet."""
    return canonical.look_alike_classes(snippets(spark, sf_dir), "tbl", "record_id", "text").withColumnsRenamed({"source": "tbl", "row_id": "record_id"})


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    census = table(spark, sf_dir, "law_census").selectExpr("'law_census' AS tbl", "row_id", "title")
    docs = table(spark, sf_dir, "documents").selectExpr("'documents' AS tbl", "doc_id AS row_id", "title")
    return mojibake.damaged_texts(census.unionByName(docs), "title", ["tbl", "row_id"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose title shows wrong decoding."""
    return _damaged(spark, sf_dir).select("tbl", "row_id")


def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged titles with what could be restored."""
    return _damaged(spark, sf_dir)


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "gold_items"), "doc_id", "text", "item_id", "text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least 70 consecutive letters or digits of an item."""
    return _leaks(spark, sf_dir).where("run >= 70").select("item_id", "doc_id")


def p6_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a passage of an item within the error budget, and its distance."""
    return _leaks(spark, sf_dir)


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each item: in how many documents it leaked, exactly and nearly, and the longest leaked run and passage."""
    return leakage.report(_leaks(spark, sf_dir), table(spark, sf_dir, "gold_items"), "item_id", "text")


#: The public vocabulary that sizes are counted in; set another path here or pass it to ``mixing.mix``.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training mix, a row per slot."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), VOCABULARY)


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target share and share reached of each source, its tokens left out, and whether it sets the total."""
    targets = table(spark, sf_dir, "mix_targets")
    mixed, supply = mixing.mix_and_supply(table(spark, sf_dir, "documents"), targets, VOCABULARY)
    return mixing.shares(mixed, targets, supply)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with template fields, filler, error messages or script notices."""
    return residue.residue_documents(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id")


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages that make documents residue, with their probability."""
    scored = residue.residue_passages(table(spark, sf_dir, "documents"), "doc_id", "text")
    return scored.where(F.col("probability") >= residue.DECISION)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_confidence": p1_confidence, "p2_found": p2_found, "p2_documents": p2_documents, "p2_segments": p2_segments, "p4_found": p4_found, "p4_canonical": p4_canonical, "p4_classes": p4_classes, "p5_found": p5_found, "p5_restored": p5_restored, "p6_found": p6_found, "p6_near": p6_near, "p6_report": p6_report, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_passages": p8_passages}
SQL = sql.SQL
