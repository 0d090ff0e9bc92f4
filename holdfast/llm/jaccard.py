"""Near copies of texts by word shingles: a chosen-path join finds candidates, and their whole sets are compared."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import fresh, map_texts, stored, workers_import
from holdfast.llm.components import components, forest, resolve_links

WORDS = 5
LEAST = 0.8
#: Minima that stand for a set. Two sets share each of them with a chance equal to their similarity.
MINIMA = 64
#: A pair as alike as ``LEAST`` is to become a candidate with this chance, whatever the size of its buckets; this sets the number of runs.
RECALL = 0.9999
#: Buckets up to this size are compared at once; larger ones are split two levels deeper, and then in blocks of this size.
BUCKET = 128
#: Sets of a group of candidates that meet in one task, on either side.
BLOCK = 128
#: Pairs in a bucket whose sketches agree this much are candidates: five standard errors below ``LEAST``.
SKETCH = LEAST - 5 * math.sqrt(LEAST * (1 - LEAST) / MINIMA)
CACHE_WORDS = 400_000

_WORDS = re.compile(r"\w+").findall
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """64 bits in which every bit of ``x`` counts."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def lost(levels: int, alike: float = LEAST) -> float:
    """The chance that a pair with this share of equal minima shares no bucket of one run: a node has one child, or two different ones in a quarter of the cases."""
    other = alike * (alike * MINIMA - 1) / (MINIMA - 1)  # both of two places are equal
    gone = 0.0
    for _ in range(levels):
        one = 1 - alike * (1 - gone)
        two = 1 - 2 * alike + other + 2 * (alike - other) * gone + other * gone**2
        gone = 0.75 * one + 0.25 * two
    return gone


def missed(runs: int, levels: int = 4) -> float:
    """The chance that a pair exactly as alike as ``LEAST`` is no candidate: its sketches agree too little, or no run has it in one bucket.

    All runs draw from the same minima, so they are independent only for a given number of equal ones.
    """
    total = 0.0
    for equal in range(MINIMA + 1):
        chance = math.comb(MINIMA, equal) * LEAST**equal * (1 - LEAST) ** (MINIMA - equal)
        total += chance * (lost(levels, equal / MINIMA) ** runs if equal / MINIMA >= SKETCH else 1.0)
    return total


def runs_for(recall: float, levels: int = 4) -> int:
    """Runs that give this recall, by default for pairs whose buckets are all large."""
    if missed(10_000, levels) > 1 - recall:
        raise ValueError(f"{MINIMA} minima do not reach a recall of {recall}.")
    return next(runs for runs in range(1, 10_000) if missed(runs, levels) <= 1 - recall)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, hashes: dict) -> np.ndarray:
    """Sorted 64-bit hashes of the text's runs of five words; of all its words if there are fewer. Words are letters, digits and
    underscores, in lower case."""
    words = _WORDS(text.lower()) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(hashes) > CACHE_WORDS:
        hashes.clear()
    if len(h) < WORDS:
        return _mix((h * _ODD[: len(h)]).sum(keepdims=True) + np.uint64(len(h)))
    n = len(h) - WORDS + 1
    total = np.zeros(n, np.uint64)
    for k in range(WORDS):
        total += h[k : k + n] * _ODD[k]
    return np.unique(_mix(total))


def minima(found: np.ndarray) -> np.ndarray:
    """The smallest of the set's elements under each of ``MINIMA`` hash functions, 32 bits of it."""
    seeds = _mix(np.arange(1, 2 * MINIMA + 1, dtype=np.uint64) * _ODD[0])
    factor, shift = seeds[:MINIMA] | np.uint64(1), seeds[MINIMA:]
    low = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(found), 16_384):
        part = found[start : start + 16_384, None] * factor + shift
        low = np.minimum(low, part.min(axis=0))
    return (low >> np.uint64(32)).astype(np.uint32)


def _children(low: np.ndarray, doc: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parent, document, child): a node picks one of the minima, or two, and a document goes on to the child for its value there.

    What a node picks depends on the node alone; so documents that share a node and the picked value share the child.
    """
    draw = _mix(node ^ _ODD[1])
    first = (draw >> np.uint64(8)) % np.uint64(MINIMA)
    second = (first + np.uint64(1) + (draw >> np.uint64(32)) % np.uint64(MINIMA - 1)) % np.uint64(MINIMA)
    two = np.flatnonzero((draw & np.uint64(3)) == 0)
    parent = np.concatenate([np.arange(len(node)), two])
    place = np.concatenate([first, second[two]])
    owner = doc[parent]
    value = low[owner, place.astype(np.int64)].astype(np.uint64)
    return parent, owner, _mix(node[parent] * _ODD[2] + place * _ODD[3] + value * _ODD[4])


def paths(low: np.ndarray, runs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of the second level (document, node), in order of documents, and those of the fourth (place of the node above, node)."""
    n = len(low)
    doc = np.tile(np.arange(n), runs)
    node = np.repeat(_mix(np.arange(1, runs + 1, dtype=np.uint64) * _ODD[1]), n)
    for _ in range(2):
        _, doc, node = _children(low, doc, node)
    order = np.argsort(doc, kind="stable")
    doc, node = doc[order], node[order]
    above, deep_doc, deep = _children(low, doc, node)
    parent, _, deep = _children(low, deep_doc, deep)
    above = above[parent]
    order = np.argsort(above, kind="stable")
    return doc, node, above[order], deep[order]


def _lists(owner: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (shingles), h1 and h2 (128 bits for the whole set), sketch (8 bits of each minimum), nodes, and kids of each node."""
    runs = runs_for(RECALL)

    def make():
        hashes = _Hashes()

        def run(texts: list) -> list:
            sizes, h1, h2, rows = [], [], [], []
            for text in texts:
                found = shingles(text, hashes)
                sizes.append(len(found))
                # Sums of mixed elements: the same for the same set.
                h1.append(int(_mix(found ^ _ODD[3]).sum().astype(np.int64)) if len(found) else 0)
                h2.append(int(_mix(found + _ODD[4]).sum().astype(np.int64)) if len(found) else 0)
                rows.append(minima(found) if len(found) else np.zeros(MINIMA, np.uint32))
            low = np.stack(rows) if rows else np.zeros((0, MINIMA), np.uint32)
            filled = np.flatnonzero(np.array(sizes, np.int64) > 0)
            doc, node, above, deep = paths(low[filled], runs)
            kids = _lists(above, len(node), pa.array(deep.view(np.int64)))
            nodes = _lists(filled[doc], len(sizes), pa.array(node.view(np.int64)))
            kid_lists = pa.ListArray.from_arrays(nodes.offsets, kids)
            return [sizes, h1, h2, [x.tobytes() for x in low.astype(np.uint8)], nodes, kid_lists]

        return run

    fields = [
        ("n", "bigint", pa.int64()),
        ("h1", "bigint", pa.int64()),
        ("h2", "bigint", pa.int64()),
        ("sketch", "binary", pa.binary()),
        ("nodes", "array<bigint>", pa.list_(pa.int64())),
        ("kids", "array<array<bigint>>", pa.list_(pa.list_(pa.int64()))),
    ]
    return map_texts(docs, id_col, text_col, make, fields)


def _in_blocks(rows: DataFrame, group: str, member: str, size: str, block: int) -> DataFrame:
    """``rows`` once for each pair of blocks (lo, hi) that their block takes part in; ``mine`` is their block. Small groups have one."""
    blocks = F.ceil(F.col(size) / F.lit(block)).cast("int")
    mine = F.pmod(F.xxhash64(member, group), blocks).cast("int")
    rows = rows.withColumn("mine", mine).withColumn("_o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.withColumn("lo", F.least("mine", "_o")).withColumn("hi", F.greatest("mine", "_o")).drop("_o")


def _candidates(reps: DataFrame) -> DataFrame:
    """(a, b) with a > b: links that join everything that met in a bucket with agreeing sketches."""

    def shared(rows: DataFrame) -> DataFrame:
        counts = rows.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        return rows.join(counts, "node")

    first = shared(reps.select("rep", F.explode(F.arrays_zip("nodes", "kids")).alias("p")).select("rep", F.col("p.nodes").alias("node"), F.col("p.kids").alias("kids")))
    first = stored(first, "paths")
    deep = stored(shared(first.where(F.col("size") > BUCKET).select("rep", F.explode("kids").alias("node"))), "paths")
    marks = reps.select("rep", "sketch", "n")
    small = first.select("rep", "node", "size").unionAll(deep.select("rep", "node", "size")).where(F.col("size") <= BUCKET)
    # All of a small bucket ask, and it is one block.
    whole = small.join(marks, "rep").select("node", F.lit(0).alias("x"), F.lit(0).alias("q"), F.lit(True).alias("asks"), "rep", "n", "sketch")
    large = deep.where(F.col("size") > BUCKET).select("rep", "node", "size").join(marks, "rep")
    starred = stored(_starred(large), "stars")
    stars = starred.where(F.col("star") & (F.col("rep") != F.col("pivot"))).select(F.greatest("rep", "pivot").alias("a"), F.least("rep", "pivot").alias("b"))
    rest = starred.where(~F.col("star"))
    asking = rest.groupBy("node").agg(F.count("*").alias("m"))
    placed = starred.drop("pivot", "star").join(asking, "node")
    # Members that are like the pivot are joined by it; only the others are still compared, each with the whole bucket.
    x_blocks, q_blocks = (F.ceil(F.col(c) / F.lit(BUCKET)).cast("int") for c in ("size", "m"))

    def block(count: Column) -> Column:
        return F.pmod(F.xxhash64("rep", "node"), count).cast("int")

    def all_of(count: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), count - 1))

    held = placed.select("node", block(x_blocks).alias("x"), all_of(q_blocks).alias("q"), F.lit(False).alias("asks"), "rep", "n", "sketch")
    asks = rest.drop("pivot", "star").join(asking, "node").select("node", all_of(x_blocks).alias("x"), block(q_blocks).alias("q"), F.lit(True).alias("asks"), "rep", "n", "sketch")
    rows = whole.unionAll(held).unionAll(asks)
    groups = rows.groupBy("node", "x", "q").agg(F.collect_list(F.struct("rep", "n", "sketch", "asks")).alias("m")).where(F.size("m") > 1).select("m")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten()
            rep, n = flat.field("rep").to_numpy(), flat.field("n").to_numpy()
            asks = flat.field("asks").to_numpy(zero_copy_only=False)
            sketch = np.frombuffer(b"".join(flat.field("sketch").to_pylist()), np.uint8).reshape(-1, MINIMA)
            ends = np.cumsum(lists.value_lengths().to_numpy())
            highs, lows = [], []
            for start, end in zip([0, *ends[:-1].tolist()], ends.tolist()):
                ids, sizes, marks = rep[start:end], n[start:end], sketch[start:end]
                pairs = ([], [])
                for i in np.flatnonzero(asks[start:end]).tolist():
                    j = np.flatnonzero(_alike(marks, marks[i], sizes, sizes[i]))
                    pairs[0].append(np.full(len(j), i))
                    pairs[1].append(j)
                if not pairs[0]:
                    continue
                low = forest(ids, (np.concatenate(pairs[0]), np.concatenate(pairs[1])))
                joined = low != ids
                highs.append(ids[joined])
                lows.append(low[joined])
            if highs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(highs)), pa.array(np.concatenate(lows))], schema=schema)

    return groups.mapInArrow(meet, "a bigint, b bigint").unionAll(stars).distinct()


def _alike(marks: np.ndarray, mark: np.ndarray, sizes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which sets can be as similar as ``LEAST`` to one, or each to its own, by sketch and size."""
    return ((marks == mark).mean(axis=-1) >= SKETCH) & (np.minimum(sizes, size) >= LEAST * np.maximum(sizes, size))


def _starred(large: DataFrame) -> DataFrame:
    """``large`` (rep, node, size, sketch, n) with the bucket's pivot, its smallest id, and ``star``: whether the member is a candidate with it."""
    pivots = large.groupBy("node").agg(F.min(F.struct("rep", "n", "sketch")).alias("p"))
    pairs = large.join(pivots, "node").select("rep", "node", "size", "sketch", "n", F.col("p.rep").alias("pivot"), F.col("p.n").alias("p_n"), F.col("p.sketch").alias("p_sketch"))
    names = ["rep", "node", "size", "sketch", "n", "pivot"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            mine, theirs = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, MINIMA) for i in (3, 7))
            star = _alike(mine, theirs, batch.column(4).to_numpy(), batch.column(6).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(star)], names=[*names, "star"])

    return pairs.mapInArrow(work, "rep bigint, node bigint, size bigint, sketch binary, n bigint, pivot bigint, star boolean")


def _compare(sets: list[np.ndarray], side: np.ndarray, lo: int, hi: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets with a similarity of at least ``least``; between two blocks only pairs across them."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = counts[inverse] > 1
    owner, inverse = owner[common], inverse[common]
    used, inverse = np.unique(inverse, return_inverse=True)
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(inverse, kind="stable")
    owner, inverse = owner[order], inverse[order]
    for start in range(0, len(used), 8_192):
        a, b = np.searchsorted(inverse, [start, start + 8_192])
        part = np.zeros((len(sets), min(8_192, len(used) - start)), np.float32)
        part[owner[a:b], inverse[a:b] - start] = 1
        both += part @ part.T
    union = sizes[:, None] + sizes[None, :] - both
    good = np.triu(both >= least * union - 1e-6, 1)
    if lo != hi:
        good &= side[:, None] != side[None, :]
    return np.nonzero(good)


def _verified(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rep, n, other) for the members of groups of candidates, by their whole sets: links weighted by copies, and the smallest id in reach.

    ``members``: rep, group, size, copies.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("rep"), F.col(text_col).alias("text"))

    def make():
        hashes = _Hashes()

        def run(found: list) -> list:
            return [[shingles(t, hashes).tobytes() for t in found]]

        return run

    mine = texts.join(members.select("rep"), "rep", "left_semi")
    sets = map_texts(mine, "rep", "text", make, [("shingles", "binary", pa.binary())]).withColumnRenamed("doc_id", "rep")
    # An id with several texts keeps those of its classes apart by their shingles.
    sets = sets.select("rep", "shingles").join(members, "rep")
    rows = _in_blocks(sets, "group", "rep", "size", BLOCK)
    groups = rows.groupBy("group", "lo", "hi").agg(F.collect_list(F.struct("rep", "copies", "mine", "shingles")).alias("m")).where(F.size("m") > 1)
    schema = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("other", pa.int64())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                flat = members.values
                ids, copies, side = (flat.field(c).to_numpy() for c in ("rep", "copies", "mine"))
                held = [np.frombuffer(x.as_buffer(), np.uint64) for x in flat.field("shingles")]
                i, j = _compare(held, side, lo, hi, LEAST)
                other = ids[i] != ids[j]
                i, j = i[other], j[other]
                if not len(i):
                    continue
                n = np.bincount(i, copies[j], minlength=len(ids)) + np.bincount(j, copies[i], minlength=len(ids))
                low = forest(ids, (i, j))
                keep = n > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(n[keep].astype(np.int64)), pa.array(low[keep])], schema=schema)

    return groups.select("lo", "hi", "m").mapInArrow(meet, "rep bigint, n bigint, other bigint")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_links (other documents with a similarity of at least 0.8), component_id, kept (smallest id of its component).

    Similarity is the Jaccard coefficient of the sets of five-word shingles of whole texts. A set is stood for by ``MINIMA`` minhashes. In each run a document follows the
    paths of a tree whose nodes pick minhashes; documents with the same path meet. Buckets of up to ``BUCKET`` sets are compared at once, larger ones two levels deeper; what is
    still large shares nearly everything: members that are like one of them are joined by it, and the others are compared with all, in blocks. The number of runs follows from ``RECALL``, see ``missed``. Candidates form
    groups, and within a group all whole sets are compared, so a link that no bucket showed is found too where the group was.

    Documents with equal sets are one class: compared once, counted with all their ids. A missing text, or one without words, links with nothing; texts of fewer
    than five words have one shingle. A missing id is a row without links. Rows with the same id and text are one document; an id with several texts stands for all
    of them. Other columns are not read. An empty table gives no rows. Pairs are counted where they are found and never written.
    """
    workers_import(docs.sparkSession)
    rows = stored(signatures(docs, id_col, text_col), "shingles")
    sound = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    ids = rows.where(sound).select(F.col("doc_id").alias("id"), "h1", "h2", "n").distinct()
    classes = ids.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    marks = rows.where(sound).groupBy("h1", "h2", "n").agg(*[F.first(c).alias(c) for c in ("sketch", "nodes", "kids")])
    reps = stored(classes.join(marks, ["h1", "h2", "n"]), "sets")
    found = components(_candidates(reps))
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    by_rep = reps.groupBy("rep").agg(F.max("copies").alias("copies"))
    members = found.join(sizes, "component").join(by_rep, F.col("node") == F.col("rep"))
    members = stored(members.select("rep", F.col("component").alias("group"), "size", "copies"), "groups")
    links = stored(_verified(docs, members, id_col, text_col), "near")
    return resolve_links(rows.select(F.col("doc_id").alias("id")), ids, reps.select("h1", "h2", "rep", "copies"), links).withColumnRenamed("id", "doc_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay: of each group of near copies the one with the smallest id (a missing id comes last), with all columns.

    A document is an id with its text, known by a hash of both: texts that share an id are documents of their own, and one is not dropped for the other's sake. Repeated rows with equal id and text stay
    as one. Documents without words are no copies of each other. An empty table gives no rows.
    """
    key, gone = fresh(docs, "_key", "_gone")
    keyed = docs.withColumn(key, F.xxhash64(id_col, F.coalesce(F.col(text_col), F.lit("")), F.col(text_col).isNull()))
    plain = keyed.select(F.col(key).alias("key"), F.col(id_col).cast("bigint").alias("id"))
    repeated = stored(plain.groupBy("key").agg(F.first("id").alias("id"), F.count("*").alias("rows")), "keys")
    near = near_copies(keyed.select(F.col(key).alias("_doc"), F.col(text_col).alias("_text")), "_doc", "_text").where("n_links > 0")
    linked = stored(near.select(F.col("doc_id").alias("key"), "component_id").distinct().join(repeated.select("key", "id"), "key"), "linked")
    order = F.struct(F.col("id").isNull().alias("unset"), "id", "key")
    first = linked.groupBy("component_id").agg(F.min(order).alias("first"))
    dropped = linked.join(first, "component_id").where(F.col("key") != F.col("first.key")).select(F.col("key").alias(gone))
    left = keyed.join(dropped, F.col(key) == F.col(gone), "left_anti")
    # Few rows come twice: only those meet.
    twice = repeated.where("rows > 1").select(F.col("key").alias(gone))
    once = left.join(twice, F.col(key) == F.col(gone), "left_anti")
    again = left.join(twice, F.col(key) == F.col(gone), "left_semi").dropDuplicates([key])
    return once.unionAll(again).drop(key)
