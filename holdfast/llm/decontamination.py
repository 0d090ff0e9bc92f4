"""Benchmark passages in training text: a positional inverted index, and intersections of offset-adjusted lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.llm.common import _parts, stored, workers_import

WINDOW = 10
#: Bytes of text in a segment of the index; a longer text is a segment of its own.
SEGMENT = 1_000_000
#: Bytes of the index that a reader holds at once.
ROW_GROUP = 16_000_000
#: Positions left free between two documents of a segment, so that no match reaches from one into the next.
GAP = 64
#: Windows of test items that a task holds at once. More are dealt in blocks, each a pass over the index.
BLOCK = 100_000
#: Candidate places that are intersected at once.
AT_ONCE = 500_000
_SHIFT = 32


def _letters() -> np.ndarray:
    """For each byte: 0 if it separates words, else the byte, A-Z as a-z. Bytes from 128 on belong to words."""
    table = np.zeros(256, np.uint8)
    table[128:] = np.arange(128, 256)
    for first, last in (("0", "9"), ("a", "z")):
        table[ord(first) : ord(last) + 1] = np.arange(ord(first), ord(last) + 1)
    table[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    return table


LETTERS = _letters()


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a column of texts in order, and how many each text has; a missing text has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    data = LETTERS[data]
    inside = data > 0
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True  # a text's first and the last one's end
    begins, ends = inside.copy(), inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1] | cut[1:-1]
        ends[:-1] &= ~inside[1:] | cut[1:-1]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    compact = np.append(0, np.cumsum(ends - begins))
    words = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(compact.astype(np.int64)), pa.py_buffer(data[inside]))
    return words, np.diff(np.searchsorted(begins, offsets))


_SEGMENTS = "segment string, ids array<bigint>, lengths array<bigint>, terms array<string>, ends array<bigint>, postings binary"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional inverted index of ``docs``: one row per segment of about ``SEGMENT`` bytes of whole documents, stored in the shared folder.

    A segment has its documents (ids, lengths in words) and for each term the ascending positions of all its occurrences, 32 bits each: ``postings`` holds the lists one after another,
    ``ends`` where each ends. Positions run through the segment, with ``GAP`` free ones between documents. Documents are indexed where they are read: nothing is shuffled, and a
    lost task is repeated alone. Missing texts have no words; repeated ids and rows are indexed as often as they come; other columns are not read. An empty table gives no rows.
    """
    workers_import(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in _parts(whole, 1, SEGMENT):
                if not batch.num_rows:
                    continue
                words, lengths = words_of(batch.column(1))
                coded = words.dictionary_encode()
                terms = np.asarray(coded.indices)
                places = np.arange(len(terms)) + np.repeat(np.arange(len(lengths)) * GAP, lengths)
                order = np.argsort(terms, kind="stable")
                ends = np.cumsum(np.bincount(terms, minlength=len(coded.dictionary)))
                row = {
                    "segment": [f"{task}-{number}"],
                    "ids": [batch.column(0).to_pylist()],
                    "lengths": [lengths],
                    "terms": [coded.dictionary.cast(pa.string())],
                    "ends": [ends],
                    "postings": [places[order].astype(np.uint32).tobytes()],
                }
                number += 1
                lists = {"ids": pa.int64(), "lengths": pa.int64(), "terms": pa.string(), "ends": pa.int64()}
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.list_(lists[k])) if k in lists else pa.array(v) for k, v in row.items()})

    return stored(source.mapInArrow(work, _SEGMENTS), "postings", ROW_GROUP)


@dataclass
class Block:
    """Windows of test items: their words as numbers in ``terms``, -1 beyond the end of a short one, and the numbers of the items that have each."""

    terms: list[str]
    windows: np.ndarray
    items: list[list[int]]

    @classmethod
    def of(cls, rows: list) -> Block:
        terms = sorted({t for r in rows for t in r["words"]})
        number = {t: i for i, t in enumerate(terms)}
        windows = np.full((len(rows), max(len(r["words"]) for r in rows)), -1, np.int64)
        for i, r in enumerate(rows):
            windows[i, : len(r["words"])] = [number[t] for t in r["words"]]
        return cls(terms, windows, [list(r["items"]) for r in rows])


class Segment:
    """A segment's lists of the terms that a block asks for."""

    def __init__(self, terms: pa.Array, ends: np.ndarray, postings: np.ndarray, block: Block):
        found = pc.index_in(pa.array(block.terms, terms.type), terms).to_numpy(zero_copy_only=False)
        self.has = ~np.isnan(found) if found.dtype.kind == "f" else np.ones(len(found), bool)
        at = np.where(self.has, found, 0).astype(np.int64)
        starts = np.append(0, ends)
        first, last = np.where(self.has, starts[at] if len(ends) else 0, 0), np.where(self.has, starts[at + 1] if len(ends) else 0, 0)
        self.sizes = last - first
        # The lists of the asked terms in one array ordered by (term, position): one search serves lists of many terms.
        self.begin = np.append(0, np.cumsum(self.sizes))
        pick = np.arange(self.begin[-1]) + np.repeat(first - self.begin[:-1], self.sizes)
        self.places = postings[pick].astype(np.int64)
        self.keys = (np.repeat(np.arange(len(at)), self.sizes) << _SHIFT) | self.places

    def occurs(self, terms: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether each term has an occurrence between two positions, both included."""
        keys = (terms << _SHIFT) | np.maximum(low, 0)
        place = np.searchsorted(self.keys, keys)
        there = place < len(self.keys)
        return there & (self.keys[np.minimum(place, max(len(self.keys) - 1, 0))] <= (terms << _SHIFT) + high) if len(self.keys) else there

    def matches(self, windows: np.ndarray, slack: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, start) for every start from which each word of the window occurs at its offset, or at most ``slack`` positions from there.

        A window's rarest word proposes the starts; the lists of the others, rarest first, are shifted by their offsets and intersected with what is left.
        """
        real = windows >= 0
        able = np.flatnonzero((self.has[np.maximum(windows, 0)] | ~real).all(1) & real.any(1)) if len(windows) else np.zeros(0, np.int64)
        if not len(able):
            return
        windows, real = windows[able], real[able]
        sizes = np.where(real, self.sizes[windows], np.iinfo(np.int64).max)
        order = np.argsort(sizes, axis=1, kind="stable")
        rarest = windows[np.arange(len(windows)), order[:, 0]]
        shifts = np.arange(-slack, slack + 1)
        proposed = self.sizes[rarest] * len(shifts)
        total = np.cumsum(proposed)
        cuts = [0, *(np.flatnonzero(np.diff(total // AT_ONCE)) + 1).tolist(), len(windows)]
        for low, high in zip(cuts[:-1], cuts[1:]):
            n = self.sizes[rarest[low:high]]
            of = np.repeat(np.arange(low, high), n)
            within = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            starts = self.places[self.begin[rarest[of]] + within] - order[of, 0]
            if slack:
                of, starts = np.repeat(of, len(shifts)), (starts[:, None] + shifts).ravel()
            for k in range(0 if slack else 1, windows.shape[1]):
                offset = order[of, k]
                asked = real[of, offset]
                term, at = windows[of, offset], starts + offset
                keep = ~asked
                keep[asked] = self.occurs(term[asked], at[asked] - slack, at[asked] + slack)
                of, starts = of[keep], starts[keep]
            if slack and len(of):
                of, starts = np.unique(np.stack([of, starts]), axis=1)
            if len(of):
                yield able[of], starts


def windows_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(words, items): every distinct window of ``window`` consecutive words of a test item, and the ids of the items that have it.

    An item with fewer words, but not none, is one window. Items without id take no part.
    """
    spark = items.sparkSession
    workers_import(spark)
    source = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _parts(whole, 1, 10_000):
                words, lengths = words_of(batch.column(1))
                words = words.to_pylist()
                ids, out, end = batch.column(0).to_pylist(), [], 0
                for item, n in zip(ids, lengths.tolist()):
                    start, end = end, end + n
                    out += [(item, words[i : i + min(window, n)]) for i in range(start, start + max(n - window + 1, min(n, 1)))]
                yield pa.RecordBatch.from_pydict({"item": pa.array([i for i, _ in out], pa.string()), "words": pa.array([w for _, w in out], pa.list_(pa.string()))})

    return source.mapInArrow(work, "item string, words array<string>").groupBy("words").agg(F.collect_set("item").alias("items"))


def _covered(starts: np.ndarray, ends: np.ndarray) -> int:
    """Positions in any of the spans."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    return int((reach - np.maximum(starts, np.append(starts[0], reach[:-1]))).clip(0).sum())


_FOUND = "segment string, place int, doc_id bigint, n_words bigint, starts array<bigint>, ends array<bigint>, items array<string>, near array<string>"


def find_passages(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, slack: int | None = None) -> DataFrame:
    """One row per document of ``index``: segment, place, doc_id, n_words, starts and ends of the exact matches of windows (in words, end exclusive), items that match, and near.

    A window matches exactly where all its words follow each other. With ``slack``, ``near`` lists the items with a window whose words occur near each other: from
    some start, each word has an occurrence at most ``slack`` positions from its place (exact matches are among these); without it, near is missing.

    Each segment is intersected where it lies. Windows go to the tasks as a broadcast of at most ``BLOCK`` windows; a benchmark with more is dealt in blocks, each a pass over the stored index,
    and what the passes found is merged by document.
    """
    spark = index.sparkSession
    workers_import(spark)
    if slack is not None and window + 2 * slack >= GAP:
        raise ValueError(f"window + 2 * slack must be below {GAP}")
    windows = stored(windows_of(items, id_col, text_col, window), "windows")
    blocks = max(1, -(-windows.count() // BLOCK))
    number = F.pmod(F.xxhash64("words"), F.lit(blocks))
    passes = None
    for k in range(blocks):
        block = spark.sparkContext.broadcast(_block(windows.where(number == k)))
        one = index.mapInArrow(_matcher(block, slack), _FOUND)
        passes = one if passes is None else passes.unionAll(one)
    if blocks == 1:
        return passes
    # One row per pass for each document, spans and items as each pass found them.
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends")]
    sets = [F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("items", "near")]
    return passes.groupBy("segment", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *lists, *sets)


def _block(windows: DataFrame) -> Block | None:
    rows = windows.collect()
    return Block.of(rows) if rows else None


def _matcher(block, slack: int | None):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = block.value
        for batch in batches:
            for row in range(batch.num_rows):
                name, ids, lengths, terms, ends, postings = (batch.column(i)[row] for i in range(6))
                lengths = lengths.values.to_numpy(zero_copy_only=False)
                n = len(lengths)
                first = np.append(0, np.cumsum(lengths + GAP))
                empty = np.zeros(0, np.int64)
                found, near = [(empty, empty)], [(empty, empty)]
                if asked is not None and len(terms.values):
                    segment = Segment(terms.values, ends.values.to_numpy(), np.frombuffer(postings.as_buffer(), np.uint32), asked)
                    found += list(segment.matches(asked.windows, 0))
                    if slack is not None:
                        near += list(segment.matches(asked.windows, slack))
                which, starts = (np.concatenate(x) for x in zip(*found))
                doc = np.searchsorted(first, starts, "right") - 1
                order = np.argsort(doc, kind="stable")
                which, starts, doc = which[order], starts[order] - first[doc[order]], doc[order]
                spans = starts + (asked.windows[which] >= 0).sum(1) if len(which) else starts
                bounds = np.searchsorted(doc, np.arange(n + 1))

                def items_of(windows: np.ndarray) -> list[str]:
                    return sorted({i for w in np.unique(windows).tolist() for i in asked.items[w]})

                near_of: list = [None] * n
                if slack is not None:
                    w, s = (np.concatenate(x) for x in zip(*near))
                    # A start may lie up to slack before its document; what it found does not.
                    d = np.searchsorted(first, s + slack, "right") - 1
                    near_of = [items_of(w[d == i]) if (d == i).any() else [] for i in range(n)] if len(w) else [[] for _ in range(n)]
                pairs = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
                yield pa.RecordBatch.from_pydict(
                    {
                        "segment": pa.array([name.as_py()] * n, pa.string()),
                        "place": pa.array(range(n), pa.int32()),
                        "doc_id": ids.values.cast(pa.int64()),
                        "n_words": pa.array(lengths, pa.int64()),
                        "starts": pa.array([starts[a:b] for a, b in pairs], pa.list_(pa.int64())),
                        "ends": pa.array([spans[a:b] for a, b in pairs], pa.list_(pa.int64())),
                        "items": pa.array([items_of(which[a:b]) if b > a else [] for a, b in pairs], pa.list_(pa.string())),
                        "near": pa.array(near_of, pa.list_(pa.string())),
                    }
                )

    return work


@F.pandas_udf(T.LongType())
def _n_covered(starts: pd.Series, ends: pd.Series) -> pd.Series:
    return pd.Series([_covered(np.asarray(a), np.asarray(b)) if len(a) else 0 for a, b in zip(starts, ends)], dtype="int64")


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slack: int | None = None
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit (words inside any exact match), n_items, items_sha256, contaminated, and n_near (items that match within ``slack``).

    Words are runs of a-z, 0-9 and anything beyond ASCII, after A-Z became a-z. Missing and empty texts, on either side, have no words and no hits. Equal
    items count each with its id; an id that comes twice counts once. ``items_sha256`` is that of the ids sorted as strings and joined by commas. Repeated
    documents give a row each; an empty table gives no rows. Other columns are not read.
    """
    found = find_passages(build_index(docs, id_col, text_col), items, item_col, item_text_col, window, slack)
    hit = _n_covered("starts", "ends")
    joined = F.array_join(F.array_sort("items"), ",")
    out = found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), F.size("near").cast("bigint").alias("n_near"))
    out = out.withColumn("contaminated", F.col("n_hit") > 0)
    return out if slack is not None else out.drop("n_near")
