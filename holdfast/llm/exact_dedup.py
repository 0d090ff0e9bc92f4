"""Exact copies: groups by a 128-bit hash, with the bytes compared inside each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import SPACE, fresh, text_of

_MAX_ID = 9223372036854775807
_ID_SPAN = "100000000000000000000"


def _rank(points: Column, doc_id: Column) -> Column:
    """More code points first, then the smaller id, a missing id last, as one decimal.

    A decimal fits the fixed-width buffers of hash aggregation, a struct does not and would mean sorting the texts.
    """
    by_id = F.coalesce(F.lit(_MAX_ID).cast("decimal(20,0)") - doc_id.cast("decimal(20,0)") + F.lit(1), F.lit(0).cast("decimal(21,0)"))
    return (points.cast("decimal(10,0)") * F.lit(_ID_SPAN).cast("decimal(21,0)") + by_id).cast("decimal(33,0)")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and n_points (code points of the text).

    Texts are equal when they are the same without white space. The aggregate is keyed by the hash and the text, so
    equal hashes of different texts stay apart: Spark compares the bytes of keys whose hashes meet. Copies vanish in the partial
    aggregate, before the shuffle, whatever the size of their group. The way back to the rows is a join of narrow
    rows, whose hot keys adaptive execution splits.

    Missing texts are empty texts, and all texts without content form one group. A missing id loses every tie.
    Rows with the same id and text are the same document: each of them reports the same decision, see ``keep_exact``.
    Other columns are not looked at. An empty table gives no rows.
    """
    text = text_of(text_col)
    plain = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.length(text).cast("bigint").alias("n_points"),
        F.regexp_replace(text, SPACE + "+", "").alias("_plain"),
    )
    hashed = plain.withColumn("_md5", F.unhex(F.md5("_plain")))
    groups = (
        hashed.groupBy("_md5", "_plain")
        .agg(F.count("*").alias("group_size"), F.max(_rank(F.col("n_points"), F.col("doc_id"))).alias("_best"))
        .select("_md5", F.sha2("_plain", 256).alias("text_sha256"), "group_size", "_best")
    )
    by_id = F.col("_best") % F.lit(_ID_SPAN).cast("decimal(21,0)")
    groups = groups.select(
        "_md5",
        "text_sha256",
        "group_size",
        F.when(by_id > 0, F.lit(_MAX_ID).cast("decimal(20,0)") - by_id + F.lit(1)).cast("bigint").alias("keep_id"),
        ((F.col("_best") - by_id) / F.lit(_ID_SPAN).cast("decimal(21,0)")).cast("bigint").alias("_most"),
    )
    rows = hashed.select("doc_id", "n_points", "_md5", F.sha2("_plain", 256).alias("text_sha256"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("_most"))
    return rows.join(groups, ["_md5", "text_sha256"]).select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "n_points")


def keep_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, one per group, with all their columns."""
    text = text_of(text_col)
    doc, points, sha = fresh(docs, "_id", "_points", "_sha")
    kept = exact_groups(docs, id_col, text_col).where("kept")
    kept = kept.select(F.col("doc_id").alias("id"), F.col("n_points").alias("n"), F.col("text_sha256").alias("digest")).distinct()
    left = docs.select(
        "*",
        F.col(id_col).cast("bigint").alias(doc),
        F.length(text).cast("bigint").alias(points),
        F.sha2(F.regexp_replace(text, SPACE + "+", ""), 256).alias(sha),
    )
    same = left[doc].eqNullSafe(kept["id"]) & (left[points] == kept["n"]) & (left[sha] == kept["digest"])
    return left.join(kept, same, "left_semi").dropDuplicates([doc, points, sha]).drop(doc, points, sha)
