"""Near copies of vectors: inverted lists around coarse centroids, residuals in product codes, and an exact check of what the codes let pass."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import stored, workers_import
from holdfast.llm.components import forest, resolve_links

#: The index is fitted on so many vectors at most, and numbers in them; all vectors are indexed.
SAMPLE_VECTORS = 20_000
SAMPLE_NUMBERS = 4_000_000
#: Centroids at most: some 4096 * dim doubles are sent to each executor. Any number of lists gives the same links.
MAX_LISTS = 4096
PARTS = 8
CODES = 256
ROUNDS = 8
#: Rows of a list that meet in one task on either side; longer lists are split into blocks, and the blocks meet in pairs.
BLOCK = 2048
#: How far beyond the plane between two lists links are looked for. None looks as far as geometry allows, and misses none whatever the data. A
#: number looks that many standard deviations far, and misses pairs where differences point in some directions more than in others.
SPREAD: float | None = None
_SLACK = 1e-7


def _means(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k centres by Lloyd's rounds; an empty one moves to a random point."""
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(ROUNDS):
        nearest = _nearest(points, centres)
        counts = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
        centres[~full] = points[rng.integers(0, len(points), int((~full).sum()))]
    return centres


def _squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1), 0)


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    step = max(1, 8_000_000 // len(centres))
    return np.concatenate([_squares(points[i : i + step], centres).argmin(1) for i in range(0, len(points), step)])


@dataclass
class Index:
    """Coarse centroids, and for each part of the vector its columns and the codes of its residuals."""

    centres: np.ndarray
    columns: list[np.ndarray]
    books: list[np.ndarray]

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, seed: int = 5) -> Index:
        rng = np.random.default_rng(seed)
        centres = _means(sample, lists, rng)
        rest = sample - centres[_nearest(sample, centres)]
        columns = [c for c in np.array_split(np.arange(sample.shape[1]), PARTS) if len(c)]
        return cls(centres, columns, [_means(rest[:, c], CODES, rng) for c in columns])

    def encode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, and how far the coded vector is from the real one."""
        lists = _nearest(units, self.centres)
        rest = units - self.centres[lists]
        codes = np.stack([_nearest(rest[:, c], book) for c, book in zip(self.columns, self.books)], axis=1).astype(np.uint8)
        for k, (c, book) in enumerate(zip(self.columns, self.books)):
            rest[:, c] -= book[codes[:, k]]
        return lists, codes, np.sqrt((rest**2).sum(1))

    def probes(self, units: np.ndarray, radius: float, spread: float | None = SPREAD, homes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) for every list that can hold a vector within ``radius``.

        A vector of list c lies on c's side of the plane half-way between c and the row's own centroid; the row's distance
        to that plane is (d_c^2 - d_own^2) / (2 |c - own|). Lists beyond ``radius`` hold nothing, whatever the data; these probes are sufficient without
        ``spread``. A difference of that length that points nowhere in particular crosses the plane by radius / sqrt(dim) as a standard
        deviation, and ``spread`` of those are looked at. ``homes`` are the rows' own lists, where they are known.
        """
        if spread is not None:
            radius = min(radius, spread * radius / np.sqrt(units.shape[1]))
        apart = np.sqrt(_squares(self.centres, self.centres))
        rows, lists = [], []
        step = max(1, 4_000_000 // len(self.centres))
        for start in range(0, len(units), step):
            d = _squares(units[start : start + step], self.centres)
            own = d.argmin(1) if homes is None else homes[start : start + step]
            at = np.arange(len(d))
            reach = d - d[at, own][:, None] <= 2 * (radius + _SLACK) * apart[own] + _SLACK
            reach[at, own] = True
            i, c = np.nonzero(reach)
            rows.append(i + start)
            lists.append(c)
        return np.concatenate(rows), np.concatenate(lists)

    def here(self, queries: np.ndarray, homes: np.ndarray, units: np.ndarray, number: int) -> np.ndarray:
        """Whether pairs (query of list ``homes``, row of list ``number``) count in list ``number``: where the middle of the pair is nearer to its centroid.

        The middle of a pair within ``radius`` is half of that away from either row. So the row whose list does not have the middle is within
        radius / 2 of the plane between the two lists, and probes of radius / 2 by both rows find every pair. Both lists work with the same numbers in the same order,
        so exactly one of them counts the pair.
        """
        low, high = np.minimum(homes, number), np.maximum(homes, number)
        norms = (self.centres**2).sum(1)
        at_low = ((queries + units) * (self.centres[low] - self.centres[high])).sum(1) >= norms[low] - norms[high]
        return at_low == (low == number)

    def near(self, queries: np.ndarray, units: np.ndarray, number: int, codes: np.ndarray, errors: np.ndarray, radius: float, least: float, homes: np.ndarray | None = None):
        """Pairs (query, row of list ``number``) whose cosine is at least ``least``; with ``homes``, the lists of the queries, those that count ``here``.

        A query keeps one table per part of the vector: its squared distance to each of the code words there. The distance to a code is the sum of what its bytes point at, so no
        vector of the list is looked at. A real distance differs from that to the code by the code's error at most, so nothing is lost by dropping pairs whose coded distance is above radius + error; the
        others are reranked by their exact cosine.
        """
        homes = np.full(len(queries), number) if homes is None else homes
        rest = queries - self.centres[number]
        limits = (radius + errors + _SLACK) ** 2
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = max(1, 4_000_000 // max(1, len(units)))
        for first in range(0, len(rest), step):
            part = rest[first : first + step]
            coded = np.zeros((len(part), len(units)))
            for k, (c, book) in enumerate(zip(self.columns, self.books)):
                coded += np.take(_squares(part[:, c], book), codes[:, k], axis=1)
            i, j = np.nonzero(coded <= limits)
            for start in range(0, len(i), 100_000):
                x, y = i[start : start + 100_000] + first, j[start : start + 100_000]
                keep = np.einsum("ij,ij->i", queries[x], units[y]) >= least
                x, y = x[keep], y[keep]
                # Pairs of one list are found there alone.
                apart = np.flatnonzero(homes[x] != number)
                keep = np.ones(len(x), bool)
                keep[apart] = self.here(queries[x[apart]], homes[x[apart]], units[y[apart]], number)
                left.append(x[keep])
                right.append(y[keep])
        return np.concatenate(left), np.concatenate(right)


def _units(values: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; scaled twice, so that squares of large or tiny numbers stay finite."""
    values = values / np.abs(values).max(1, keepdims=True)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def _unpacked(column: pd.Series, dim: int) -> np.ndarray:
    """Vectors from bytes of single or double numbers."""
    out = np.empty((len(column), dim))
    for i, data in enumerate(column):
        out[i] = np.frombuffer(data, np.float32 if len(data) == 4 * dim else np.float64)
    return out


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, spread: float | None = SPREAD) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors with a cosine of at least ``least``), component_id, kept (smallest id of its component).

    Vectors that are missing, zero, or hold missing or non-finite numbers link with nothing, and so do vectors of different length. Equal vectors
    are compared once and count with all their ids. Rows with equal id and vector are one vector; ids with several vectors get the sum of their links. A
    missing id is a row without links. Other columns are not read. An empty table gives no rows.

    Links are looked for in every list that can hold them, see ``Index.probes`` and ``Index.here``; limits on coded distances lose nothing, and what they let pass is checked
    exactly. All links are found, whatever the data, unless ``spread`` is given. Rows go to the lists they can have links in; a list that is longer than ``BLOCK`` is split into blocks on both sides,
    so a list that holds a third of all vectors is many tasks. Pairs are counted where they are found and never written.
    """
    spark = vectors.sparkSession
    workers_import(spark)
    numbers = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), numbers.alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    sound = F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False))
    keys = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), F.col("v")).alias("h2")]
    rows = rows.select("vec_id", "v", sound.alias("sound"), *keys)
    known = rows.where("sound").select("vec_id", "h1", "h2", F.size("v").alias("dim"), "v")
    # Equal vectors become one; ids of a class are counted, never gathered.
    ids = known.select(F.col("vec_id").alias("id"), "h1", "h2", "dim").distinct()
    classes = ids.groupBy("h1", "h2", "dim").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    one_each = known.select("h1", "h2", "v").groupBy("h1", "h2").agg(F.first("v").alias("v"))
    reps = stored(classes.join(one_each, ["h1", "h2"]), "vectors")

    # One entry per vector length: as good as always one.
    found = None
    for dim, count in sorted((r["dim"], r["n"]) for r in reps.groupBy("dim").agg(F.count("*").alias("n")).collect()):
        part = _links(reps.where(F.col("dim") == dim), count, dim, least, spread)
        found = part if found is None else found.unionAll(part)
    none = spark.createDataFrame([], "rep bigint, n bigint, other bigint")
    links = none if found is None else stored(found, "near")
    return resolve_links(rows.select(F.col("vec_id").alias("id")), ids, classes, links).withColumnRenamed("id", "vec_id")


def _links(reps: DataFrame, count: int, dim: int, least: float, spread: float | None) -> DataFrame:
    """(rep, n, other) for vectors of one length: links of ``rep`` found in one place, weighted by copies, and the smallest id in reach there."""
    spark = reps.sparkSession
    radius = float(np.sqrt(max(0.0, 2 - 2 * least)))
    limit = min(SAMPLE_VECTORS, max(256, SAMPLE_NUMBERS // dim))
    sample = reps.where(F.pmod(F.xxhash64("rep"), F.lit(1_000_000)) <= int(min(1.0, limit / count) * 1_000_000)).select("v").limit(2 * limit)
    got = np.array([r["v"] for r in sample.collect()] or [r["v"] for r in reps.select("v").limit(1).collect()], dtype=np.float64)
    got = got[np.lexsort(got.T[::-1])]  # an order of its own, whichever task came first
    got = _units(got)
    # Probes are a share of the lists that falls slowly with their number: more lists spare comparisons and copy rows more often.
    lists = max(1, min(MAX_LISTS, round(count**0.35), len(got)))
    index = spark.sparkContext.broadcast(Index.fit(got, lists))
    schema = pa.schema([("rep", pa.int64()), ("copies", pa.int64()), ("vector", pa.binary()), ("home", pa.int32()), ("lists", pa.list_(pa.int32())), ("codes", pa.binary()), ("error", pa.float64())])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.array(batch.column(2).to_pylist(), dtype=np.float64)
            values = _units(raw)
            for start in range(0, len(values), 2_000):
                units = np.ascontiguousarray(values[start : start + 2_000])
                homes, codes, errors = index.value.encode(units)
                row, to = index.value.probes(units, radius / 2, spread, homes)
                ends = np.cumsum(np.bincount(row, minlength=len(units)))
                # As narrow as the numbers allow: they travel as they came and are scaled again where they meet.
                given = raw[start : start + 2_000]
                narrow = given.astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(units)),
                        batch.column(1).slice(start, len(units)),
                        pa.array([v.tobytes() for v in (narrow if (narrow == given).all() else given)], pa.binary()),
                        pa.array(homes, pa.int32()),
                        pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(to, pa.int32())),
                        pa.array([c.tobytes() for c in codes], pa.binary()),
                        pa.array(errors),
                    ],
                    schema=schema,
                )

    coded = reps.select("rep", "copies", "v").mapInArrow(route, "rep bigint, copies bigint, vector binary, home int, lists array<int>, codes binary, error double")
    # Written once for each row; copies are made where they are dealt out.
    coded = stored(coded, "lists")
    held = coded.select("rep", "copies", "vector", "home", F.col("home").alias("list"), F.lit(True).alias("first"), "codes", "error")
    asking = coded.select("rep", "copies", "vector", "home", F.explode("lists").alias("list"), F.lit(False).alias("first"), F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("error"))
    # Each row once as part of its own list, then once for every list it asks.
    routed = held.unionAll(asking)
    # One row per list: MAX_LISTS at most.
    sizes = routed.groupBy("list").agg(F.count_if("first").alias("rows"), F.count_if(~F.col("first")).alias("asks"))
    blocks = sizes.select("list", F.ceil(F.greatest("rows", F.lit(1)) / BLOCK).cast("int").alias("row_blocks"), F.ceil(F.greatest("asks", F.lit(1)) / BLOCK).cast("int").alias("ask_blocks"))
    placed = routed.join(F.broadcast(blocks), "list")
    mine = F.pmod(F.xxhash64("rep", "list"), F.when(F.col("first"), F.col("row_blocks")).otherwise(F.col("ask_blocks"))).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.when(F.col("first"), F.col("ask_blocks")).otherwise(F.col("row_blocks")) - 1))
    placed = placed.select("rep", "copies", "vector", "list", "home", "first", "codes", "error", mine.alias("mine"), others.alias("other"))
    placed = placed.select("*", F.when(F.col("first"), F.col("mine")).otherwise(F.col("other")).alias("x"), F.when(F.col("first"), F.col("other")).otherwise(F.col("mine")).alias("q"))

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        held, asked = group[group["first"]], group[~group["first"]]
        none = pd.DataFrame({"rep": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64"), "other": pd.Series(dtype="int64")})
        if not len(held) or not len(asked):
            return none
        units, queries = _units(_unpacked(held["vector"], dim)), _units(_unpacked(asked["vector"], dim))
        codes = np.frombuffer(b"".join(held["codes"]), np.uint8).reshape(len(held), -1)
        number, homes = int(held["list"].iloc[0]), asked["home"].to_numpy()
        i, j = index.value.near(queries, units, number, codes, held["error"].to_numpy(), radius, least, homes)
        of_q, of_x = asked["rep"].to_numpy(), held["rep"].to_numpy()
        other = of_q[i] != of_x[j]
        i, j = i[other], j[other]
        if not len(i):
            return none
        own = homes[i] == number
        n_q = np.bincount(i, held["copies"].to_numpy()[j], minlength=len(asked))
        # Within one list both rows of a pair ask; across lists they count once, for both.
        n_x = np.bincount(j[~own], asked["copies"].to_numpy()[i[~own]], minlength=len(held))
        low = forest(np.concatenate([of_q, of_x]), (i, j + len(asked)))
        n = np.concatenate([n_q, n_x]).astype(np.int64)
        out = pd.DataFrame({"rep": np.concatenate([of_q, of_x]), "n": n, "other": low})
        return out[(out["n"] > 0) | (out["rep"] != out["other"])]

    return placed.groupBy("list", "x", "q").applyInPandas(meet, "rep bigint, n bigint, other bigint")
