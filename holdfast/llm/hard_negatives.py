"""Hard negatives for anchors: the threshold algorithm over blocks of candidates, each with one sorted list per dimension."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from holdfast.llm.common import stored, workers_import

#: Candidates and anchors that meet in one task at most, about. More rows make more blocks, and every pair of blocks meets.
CANDIDATES = 32_768
ANCHORS = 4_096
#: Blocks are not made smaller than this to occupy more cores.
LEAST_BLOCK = 256
#: Entries read from each list before the first look at the threshold; then twice as many each time.
FIRST_DEPTH = 16
#: Whole numbers up to here are exact as doubles.
_EXACT = 2**53
#: Larger components count as this: sums of their products then stay within the 38 digits of a decimal.
LARGEST = 1e15
_LONG = 2**63 - 1


class Lists:
    """A block of candidates with its sorted lists, one per dimension, and random access to whole vectors."""

    def __init__(self, ids: np.ndarray, ties: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        # Ascending ids (and hashes of rows that share one): a stable sort by score then breaks ties as it should.
        order = np.lexsort((ties, ids))
        self.ids, self.ties, self.labels, self.vectors = ids[order], ties[order], labels[order], vectors[order]
        self.sorted = np.argsort(self.vectors, axis=0, kind="stable")

    def scored(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, object]]:
        """Batches (rows, scores, threshold): rows not seen before, and a bound on the scores of all rows not seen yet (None at the end).

        Lists are read from their large end where the anchor's component is positive and from the small end where it is negative; dimensions in which
        the anchor is zero add nothing to any score and are not read.
        """
        n = len(self.ids)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        seen = np.zeros(n, bool)
        depth = 0 if len(up) + len(down) else n
        if depth == n:
            yield np.arange(n), self.vectors @ anchor, None
            return
        step = FIRST_DEPTH
        while depth < n:
            end = min(n, depth + step)
            reached = np.zeros(n, bool)
            reached[self.sorted[n - end : n - depth, up].ravel()] = True
            reached[self.sorted[depth:end, down].ravel()] = True
            rows = np.flatnonzero(reached & ~seen)
            seen |= reached
            last = self.vectors[self.sorted[n - end, up], up] @ anchor[up] + self.vectors[self.sorted[end - 1, down], down] @ anchor[down]
            depth, step = end, 2 * step
            yield rows, self.vectors[rows] @ anchor, None if depth == n else last

    def best(self, anchor: np.ndarray, own: int, own_tie: int, label: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the first ``k`` rows of the anchor's label, without the anchor itself."""
        fits = (self.labels == label) & ~((self.ids == own) & (self.ties == own_tie))
        rows, scores = np.zeros(0, np.int64), np.zeros(0, self.vectors.dtype)
        for new, values, bound in self.scored(anchor):
            keep = fits[new]
            rows, scores = _first(np.append(rows, new[keep]), np.append(scores, values[keep]), k)
            if bound is not None and len(rows) == k and bound < scores[-1]:
                break
        return rows, scores

    def windows(self, anchor: np.ndarray, label: int, positives: list, low: int, high: int, of: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each positive score p: rows and scores of the first ``k`` rows of other labels with low * p <= of * score <= high * p."""
        fits = self.labels != label
        found = [(np.zeros(0, np.int64), np.zeros(0, self.vectors.dtype)) for _ in positives]
        open_ = set(range(len(positives)))
        for new, values, bound in self.scored(anchor):
            keep = fits[new]
            new, values = new[keep], values[keep]
            for i in list(open_):
                p = positives[i]
                inside = (low * p <= of * values) & (of * values <= high * p)
                found[i] = _first(np.append(found[i][0], new[inside]), np.append(found[i][1], values[inside]), k)
                # Nothing unseen can enter: its score is below the k-th, or below the window.
                full = len(found[i][0]) == k
                if bound is not None and (of * bound < low * p or (full and bound < found[i][1][-1])):
                    open_.discard(i)
            if not open_:
                break
        return found


def _first(rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` by score, ties by place."""
    if len(rows) > 4 * k and scores.dtype != object:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        rows, scores = rows[scores >= least], scores[scores >= least]
    if scores.dtype == object:
        order = sorted(range(len(rows)), key=lambda i: (-scores[i], rows[i]))[:k]
    else:
        order = np.lexsort((rows, -scores))[:k]
    return rows[order], scores[order]


def _exactly(candidates: pd.Series, anchors: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles while every score is exact so; else as Python's own integers."""
    c, a = (np.frombuffer(b"".join(x), np.int64).reshape(len(x), dim) for x in (candidates, anchors))
    large = [max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) for x in (c, a)]
    # A window compares 100 times a score.
    if large[0] * large[1] * max(dim, 1) * 128 < _EXACT:
        return c.astype(np.float64), a.astype(np.float64)
    return c.astype(object), a.astype(object)


def _longs(values: np.ndarray) -> np.ndarray:
    return np.array([max(-_LONG, min(_LONG, int(v))) for v in values], np.int64)


def _packed(rows: DataFrame) -> DataFrame:
    """Components as bytes of 64-bit numbers: a block is one buffer then."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("q")
            column = batch.column(at)
            flat, offsets = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), column.offsets.to_numpy()
            start = offsets[0]
            packed = pa.array([flat[a - start : b - start].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())
            arrays = [packed if i == at else x for i, x in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    kinds = ", ".join(f"{f.name} {'binary' if f.name == 'q' else f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(work, kinds)


def _blocks(rows: int, most: int, wanted: int) -> int:
    return max(1, -(-rows // most), min(wanted, rows // LEAST_BLOCK))


def _all_blocks(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def mine(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label: Column | None = None,
    every: int = 100,
    n_positives: int = 5,
    n_negatives: int = 10,
    low: int = 30,
    high: int = 90,
    of: int = 100,
    scale: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(``scale`` * x); a score is the integer inner product with the anchor; larger scores come first, ties by smaller id. Anchors
    are the rows whose id is divisible by ``every``. For each of an anchor's first ``n_positives`` rows of its own label, the first
    ``n_negatives`` rows of other labels whose score s satisfies ``low`` * p <= ``of`` * s <= ``high`` * p, where p is the positive's score. A positive without such
    rows gives none.

    Candidates are dealt into blocks by a hash of the row, anchors likewise, and every anchor block meets every candidate block in a task of its own. There the
    threshold algorithm runs for each anchor: see ``Lists``. Blocks are as large as memory allows and no larger, so a label or a vector that makes up a third of the
    table is spread like any other. Each block gives its own first rows; the first of those are the first of all.

    Rows without id, label or vector, and rows with a missing or non-finite component take no part. Rows equal in id, label and vector are one
    row; different rows that share an id are different rows, and their ties go by a hash. Rows meet only rows with vectors of the same length; empty
    vectors score 0. Components beyond ``LARGEST`` count as that; scores are exact, and those
    beyond 64 bits are reported as the largest number of 64 bits.
    Other columns are not read. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    workers_import(spark)
    label = F.col("label") if label is None else label
    numbers = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), numbers.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    whole = F.transform("v", lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(LARGEST)), F.lit(-LARGEST))))
    rows = rows.select("id", "label", F.size("v").alias("dim"), whole.alias("q"))
    rows = rows.withColumn("tie", F.xxhash64("label", "q"))
    rows = stored(_packed(rows).dropDuplicates(["id", "label", "tie"]), "candidates")
    anchors = rows.where(F.col("id") % every == 0)

    counts = rows.agg(F.count("*").alias("n"), F.count_if(F.col("id") % every == 0).alias("a")).first()
    wanted = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_blocks, a_blocks = _blocks(counts["n"], CANDIDATES, wanted), _blocks(counts["a"], ANCHORS, 1)
    held = rows.withColumn("block", F.pmod(F.xxhash64("id", "tie"), F.lit(n_blocks)).cast("int")).withColumn("part", _all_blocks(F.lit(a_blocks)))
    key = ["dim", "block", "part"]

    def placed(queries: DataFrame) -> DataFrame:
        part = F.pmod(F.xxhash64(F.lit(7), "id", "tie"), F.lit(a_blocks)).cast("int")
        # Columns of their own: the two sides of a cogroup must not share any.
        queries = queries.select(*[F.col(c).alias(c) for c in queries.columns])
        return queries.withColumn("part", part).withColumn("block", _all_blocks(F.lit(n_blocks)))

    def positives_of(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(held) and len(asked):
            c, a = _exactly(held["q"], asked["q"], int(asked["dim"].iloc[0]))
            lists = {}
            labels = held["label"].to_numpy()
            for i, (own, tie, of_label) in enumerate(zip(asked["id"], asked["tie"], asked["label"])):
                if of_label not in lists:
                    at = np.flatnonzero(labels == of_label)
                    lists[of_label] = Lists(held["id"].to_numpy()[at], held["tie"].to_numpy()[at], labels[at], c[at])
                block = lists[of_label]
                found, scores = block.best(a[i], own, tie, of_label, n_positives)
                out += [(own, tie, int(block.ids[r]), int(block.ties[r]), str(int(s))) for r, s in zip(found, scores)]
        return pd.DataFrame(out, columns=["id", "tie", "positive", "positive_tie", "score"])

    kinds = "id bigint, tie bigint, positive bigint, positive_tie bigint, score string"
    found = held.groupBy(*key).cogroup(placed(anchors).groupBy(*key)).applyInPandas(positives_of, kinds)
    # Scores as text hold any number of digits; their order is that of decimals.
    order = [F.col("score").cast("decimal(38,0)").desc(), F.col("positive"), F.col("positive_tie")]
    nearest = found.withColumn("place", F.row_number().over(W.partitionBy("id", "tie").orderBy(*order))).where(F.col("place") <= n_positives)
    asked = nearest.groupBy("id", "tie").agg(F.collect_list(F.struct("place", "positive", "score")).alias("positives"))
    asked = stored(anchors.join(asked, ["id", "tie"]), "positives")

    def negatives_of(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(held) and len(asked):
            c, a = _exactly(held["q"], asked["q"], int(asked["dim"].iloc[0]))
            block = Lists(held["id"].to_numpy(), held["tie"].to_numpy(), held["label"].to_numpy(), c)
            for i, (own, tie, of_label, positives) in enumerate(zip(asked["id"], asked["tie"], asked["label"], asked["positives"])):
                scores = [int(p["score"]) for p in positives]
                for p, (negatives, values) in zip(positives, block.windows(a[i], of_label, scores, low, high, of, n_negatives)):
                    out += [(own, tie, p["place"], p["positive"], p["score"], int(block.ids[r]), int(block.ties[r]), str(int(s))) for r, s in zip(negatives, values)]
        return pd.DataFrame(out, columns=["id", "tie", "place", "positive", "positive_score", "negative", "negative_tie", "score"])

    kinds = "id bigint, tie bigint, place int, positive bigint, positive_score string, negative bigint, negative_tie bigint, score string"
    found = held.groupBy(*key).cogroup(placed(asked).groupBy(*key)).applyInPandas(negatives_of, kinds)
    order = [F.col("score").cast("decimal(38,0)").desc(), F.col("negative"), F.col("negative_tie")]
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("id", "tie", "place").orderBy(*order))).where(F.col("rank") <= n_negatives)

    def long(name: str) -> Column:
        return F.greatest(F.least(F.col(name).cast("decimal(38,0)"), F.lit(_LONG)), F.lit(-_LONG)).cast("bigint")

    return ranked.select(
        F.col("id").alias("anchor_id"),
        F.col("positive").alias("positive_id"),
        "rank",
        F.col("negative").alias("negative_id"),
        long("positive_score").alias("positive_score"),
        long("score").alias("negative_score"),
    )
