"""The trie of conversation prefixes: a count-min sketch of prefix digests proves most of them single, and only the others are shuffled and grouped."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from holdfast.llm.common import WORD, stored, text_of, workers_import
from holdfast.operators.joins import join_unique

#: Rows of the sketch, and cells in each at most: three bitmaps of 8 MB are what a task holds. With many more prefixes than cells more of them look shared and are shuffled;
#: the groups are exact whatever the sketch says.
ROWS = 3
MOST_CELLS = 2**26
#: Cells for each prefix, up to the limit.
CELLS_EACH = 4
#: Ids that are joined to one string before they are hashed in order.
IDS_EACH = 4096
HEADS = 20
MOST_HEAD = 4


def _digest(seed: int, *columns: Column | str) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def _running(rows: DataFrame, conv: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with running sums over each conversation in order, up to and including the row. ``rows`` has ``chunk``: ascending pieces of a conversation.

    A piece is summed in a window of its own, and gets the sums of the pieces before it: a conversation of any length is many small windows.
    """
    names = list(sums)
    inside = W.partitionBy(conv, "chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = rows.select("*", *[F.sum(c).over(inside).alias(f"_in_{n}") for n, c in sums.items()])
    pieces = rows.groupBy(conv, "chunk").agg(*[F.sum(c).alias(f"_all_{n}") for n, c in sums.items()])
    earlier = W.partitionBy(conv).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    before = pieces.select(conv, "chunk", *[F.coalesce(F.sum(f"_all_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in names])
    joined = local.join(before, [conv, "chunk"])
    return joined.select(*rows.columns, *[(F.col(f"_in_{n}") + F.col(f"_before_{n}")).alias(n) for n in names])


def ordered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 1), d1 and d2 (a digest of role and text), words, and chunk: which piece of its conversation a turn is in.

    Turns go by number, missing numbers first; turns with the same number go by digest, so equal rows stay as many turns as there are. Missing roles and texts are
    empty. Rows without conversation are left out. Texts are read once and do not travel. Pieces are the ranges of a range partitioning, so a long conversation is cut
    into as many pieces as its length needs.
    """
    role, text = text_of(role_col), text_of(text_col)
    content = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.conv(F.substring(content, 1, 15), 16, 10).cast("bigint").alias("d1"),
        F.conv(F.substring(content, 16, 15), 16, 10).cast("bigint").alias("d2"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
    )
    order = ["turn", "d1", "d2"]
    rows = stored(rows, "digests")
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(rows.repartitionByRange(parts, "conv_id", *order).withColumn("chunk", F.spark_partition_id()), "turns")
    return _running(ranged, "conv_id", order, {"pos": F.lit(1)}).drop("turn")


def own_turns(turns: DataFrame) -> DataFrame:
    """Conversations as they are: (conv_id, ``ordered_turns``) rows, to build a trie of without sharing heads."""
    return turns.select("conv_id", "chunk", "pos", "d1", "d2", "words")


def with_shared_heads(turns: DataFrame, heads: int = HEADS, most: int = MOST_HEAD) -> DataFrame:
    """Every conversation c rebuilt: the first h turns of conversation c - c % ``heads``, then its own after its first h; h is crc32 of c as text, modulo ``most``.

    Heads are ``most`` - 1 turns at most, and each is taken by 2 * ``heads`` conversations at most, so the join does not grow with a hot key. A conversation without
    turns after that has no row here.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = turns.select("conv_id").distinct().select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % heads).alias("base"))
    first = turns.where((F.col("pos") < most) & (F.col("conv_id") % heads == 0)).select(F.col("conv_id").alias("base"), "pos", "d1", "d2", "words")
    head = convs.join(first, "base").where(F.col("pos") <= F.col("h"))
    taken = head.groupBy("conv_id").agg(F.count("*").alias("taken"))
    own = turns.withColumn("h", h).where(F.col("pos") > F.col("h")).join(taken, "conv_id", "left")
    own = own.withColumn("pos", F.col("pos") - F.col("h") + F.coalesce("taken", F.lit(0)))
    names = ["conv_id", "chunk", "pos", "d1", "d2", "words"]
    return head.withColumn("chunk", F.lit(-1)).select(*names).unionAll(own.select(*names))


def _cells(p1: np.ndarray, p2: np.ndarray, width: int) -> list[np.ndarray]:
    """The cell of each prefix in each row of the sketch; ``width`` is a power of two."""
    return [((p1 + np.uint64(2 * k + 1) * p2) >> np.uint64(7 * k)) & np.uint64(width - 1) for k in range(ROWS)]


def sketch(prefixes: DataFrame, width: int) -> np.ndarray:
    """Count-min sketch of the prefixes (p1, p2), told apart no further than one and more than one: a bit for each cell, set where more than one prefix row fell.

    Every task counts what it has, cells are summed, and 64 of them become one number: the driver gets ``ROWS`` * ``width`` / 64 numbers at most.
    """
    workers_import(prefixes.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p1, p2 = (batch.column(i).to_numpy().view(np.uint64) for i in range(2))
            cells = np.concatenate([c + np.uint64(k * width) for k, c in enumerate(_cells(p1, p2, width))])
            found, n = np.unique(cells, return_counts=True)
            yield pa.RecordBatch.from_pydict({"cell": pa.array(found.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    counts = prefixes.select("p1", "p2").mapInArrow(work, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1")
    bits = counts.groupBy(F.expr("cell div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(cell % 64))")).alias("bits"))
    table = np.zeros(max(1, ROWS * width // 64), np.uint64)
    got = bits.toArrow()
    table[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return table


def _shared(table: np.ndarray, p1: np.ndarray, p2: np.ndarray, width: int) -> np.ndarray:
    """False where the smallest count of a prefix's cells, its estimate, is one: that proves that no other row has it."""
    out = np.ones(len(p1), bool)
    for k, c in enumerate(_cells(p1.view(np.uint64), p2.view(np.uint64), width)):
        c = c + np.uint64(k * width)
        out &= (table[(c >> np.uint64(6)).astype(np.int64)] >> (c & np.uint64(63))) & np.uint64(1) > 0
    return out


def _screened(prefixes: DataFrame, cells: int | None) -> DataFrame:
    """``prefixes`` with ``shared`` and ``parent_shared``: whether the sketch leaves it open that another conversation has the prefix, or its parent."""
    spark = prefixes.sparkSession
    wanted = cells or min(MOST_CELLS, CELLS_EACH * max(prefixes.count(), 16))
    width = 1 << max(6, (wanted - 1).bit_length())
    table = spark.sparkContext.broadcast(sketch(prefixes, width))
    names = prefixes.columns
    at = [names.index(n) for n in ("p1", "p2", "parent1", "parent2")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [batch.column(i).to_numpy(zero_copy_only=False) for i in at]
            own, parent = (_shared(table.value, p[i], p[i + 1], width) for i in (0, 2))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(parent)], names=[*names, "shared", "parent_shared"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prefixes.schema)
    return prefixes.mapInArrow(work, f"{kinds}, shared boolean, parent_shared boolean")


def _folded(wide: Column) -> Column:
    """A sum of digests, back to 64 bits."""
    return (F.pmod(wide, F.lit(2**62).cast("decimal(20,0)"))).cast("bigint")


def _ends(members: DataFrame, key: list[str]) -> DataFrame:
    """(key, ends_sha256) of the ids (``conv_id``) of each key, ascending, joined by commas.

    Up to ``IDS_EACH`` neighbouring ids are joined in parallel first. What is left of a key is read in order as a stream of strings, none kept, because the hash
    is one of the whole list.
    """
    workers_import(members.sparkSession)
    piece = F.floor(F.col("conv_id") / F.lit(IDS_EACH)).cast("bigint")
    pieces = members.groupBy(*key, piece.alias("piece")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    sorted_ = pieces.repartition(*key).sortWithinPartitions(*key, "piece")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, digest = None, None

        def row(of: list, sha: str) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({**{k: pa.array([v], pa.int64()) for k, v in zip(key, of)}, "ends_sha256": pa.array([sha])})

        for batch in batches:
            *keys, _, ids = (c.to_pylist() for c in batch.columns)
            for *now, text in zip(*keys, ids):
                if now != of:
                    if of is not None:
                        yield row(of, digest.hexdigest())
                    of, digest = now, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(text.encode())
        if of is not None:
            yield row(of, digest.hexdigest())

    kinds = ", ".join(f"`{k}` bigint" for k in key)
    return sorted_.select(*key, "piece", "ids").mapInArrow(work, f"{kinds}, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame, cells: int | None = None) -> DataFrame:
    """One row per distinct prefix of the conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``convs`` has every conv_id once, also of those without turns, and ``turns`` rows (conv_id, chunk, pos from 1, d1, d2, words). The root is the empty prefix; of no conversations there
    is no root, and an empty table gives no rows.

    A prefix is known by two running sums of hashes of (position, digest), 124 bits. Prefixes that the sketch estimates at one are nodes of their own: their rows are made where they are, with one
    child unless the conversation ends, one leaf, and nothing saved. Only the others are grouped. A node's smallest member is the smallest member of all nodes below it on its own path, so each
    conversation stands for its prefixes from some depth on; what it saves is the words of its turns before that, and each leaf counts at the conversation that stands for it. Sums
    below a node are therefore sums over its members' rows, and no path is ever written out. Every group is a combinable aggregate.
    """
    turns = turns.withColumn("h1", _digest(11, "pos", "d1", "d2")).withColumn("h2", _digest(13, "pos", "d2", "d1"))
    # Non-negative terms: the sums of the pieces then wrap only where they are folded.
    wide = {f"s{i}": F.pmod(F.col(f"h{i}"), F.lit(2**62)).cast("decimal(20,0)") for i in (1, 2)}
    summed = _running(turns, "conv_id", ["pos"], {**wide, "so_far": F.col("words")})
    summed = summed.select("conv_id", "pos", "words", "so_far", _folded(F.col("s1")).alias("p1"), _folded(F.col("s2")).alias("p2"), *[_folded(F.col(f"s{i}") - wide[f"s{i}"]).alias(f"parent{i}") for i in (1, 2)])
    zero = [F.lit(0).cast("bigint").alias(n) for n in ("pos", "words", "so_far", "p1", "p2")]
    roots = convs.select("conv_id", *zero, F.lit(None).cast("bigint").alias("parent1"), F.lit(None).cast("bigint").alias("parent2"))
    lengths = summed.groupBy("conv_id").agg(F.max("pos").alias("length"))
    prefixes = summed.withColumn("pos", F.col("pos").cast("bigint")).unionByName(roots).join(lengths, "conv_id", "left")
    prefixes = prefixes.withColumn("length", F.coalesce("length", F.lit(0)).cast("bigint"))
    # A root has no parent: it asks for itself.
    prefixes = stored(prefixes.withColumn("parent1", F.coalesce("parent1", F.lit(0))).withColumn("parent2", F.coalesce("parent2", F.lit(0))), "prefixes")
    rows = stored(_screened(prefixes, cells), "screened")

    node = ["p1", "p2", "pos"]
    shared, single = rows.where("shared"), rows.where("NOT shared")
    groups = shared.groupBy(*node).agg(F.min("conv_id").alias("rep"), F.count("*").alias("n_convs"), F.first("parent1").alias("parent1"), F.first("parent2").alias("parent2"))
    groups = stored(groups, "groups")
    parents = groups.select(F.col("p1").alias("parent1"), F.col("p2").alias("parent2"), (F.col("pos") + 1).alias("pos"), F.col("rep").alias("parent_rep"))
    below = ["parent1", "parent2", "pos"]

    # Single nodes: all is known here but the parent's smallest member, where the parent is shared.
    inner = single.where("NOT parent_shared OR pos = 0").withColumn("parent_rep", F.when(F.col("pos") > 0, F.col("conv_id")))
    # A prefix that many share may have many children: its rows are spread.
    parent = F.struct("parent1", "parent2", "pos")
    rim = single.where("parent_shared AND pos > 0").withColumn("key", parent)
    rim = join_unique(rim, parents.select(parent.alias("key"), "parent_rep"), "key")
    ends_here = F.col("pos") == F.col("length")
    def nodes(found: DataFrame) -> DataFrame:
        return found.select(
            "conv_id", F.col("pos").alias("depth"), F.col("parent_rep").alias("parent_conv_id"), F.lit(1).cast("bigint").alias("n_convs"),
            F.when(ends_here, 0).otherwise(1).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens"),
            F.sha2(F.when(ends_here, F.col("conv_id").cast("string")).otherwise(F.lit("")).cast("binary"), 256).alias("ends_sha256"),
        )
    alone = nodes(inner).unionAll(nodes(rim.select(*inner.columns)))

    # Children of shared nodes: shared ones once each, single ones each.
    children = groups.where("pos > 0").select(*below).unionAll(single.where("parent_shared AND pos > 0").select(*below))
    children = children.groupBy(*below).agg(F.count("*").alias("n_children"))
    children = children.select(F.col("parent1").alias("p1"), F.col("parent2").alias("p2"), (F.col("pos") - 1).alias("pos"), "n_children")

    # Where each conversation begins to stand for its prefixes: with the first group of which it is the smallest member, or the first single one.
    key = F.struct(*node).alias("key")
    known = groups.join(children, node, "left").select(key, "rep", "n_children")
    placed = stored(join_unique(shared.withColumn("key", key), known, "key", counts=groups.select(key, F.col("n_convs").alias("_rows"))).drop("key"), "placed")
    stands = placed.where("rep = conv_id").select("conv_id", "pos", F.col("so_far") - F.col("words")).unionAll(single.select("conv_id", "pos", F.col("so_far") - F.col("words"))).toDF("conv_id", "from_pos", "before")
    whole = placed.where(ends_here).select("conv_id", (F.col("rep") == F.col("conv_id")) & F.col("n_children").isNull(), "so_far").toDF("conv_id", "is_leaf", "all")
    tails = single.where(ends_here).select("conv_id", F.lit(True), "so_far").toDF("conv_id", "is_leaf", "all")
    first = stands.groupBy("conv_id").agg(F.min(F.struct("from_pos", "before")).alias("f"))
    facts = whole.unionAll(tails).join(first, "conv_id", "left").select("conv_id", "is_leaf", F.coalesce("f.before", "all").alias("saving"))
    # The words before that place, from this prefix's own last turn on.
    saved = F.greatest(F.col("saving") - (F.col("so_far") - F.col("words")), F.lit(0))
    sums = placed.join(facts, "conv_id").groupBy(*node).agg(F.sum(saved).alias("saved_tokens"), F.count_if("is_leaf").alias("n_leaves"), F.max("n_children").alias("n_children"))
    ends = _ends(shared.where(ends_here).select(*node, "conv_id"), node)
    out = groups.join(sums, node).join(ends, node, "left").join(parents, below, "left")
    common = out.select(
        F.col("rep").alias("conv_id"), F.col("pos").alias("depth"), F.when(F.col("pos") > 0, F.coalesce("parent_rep", "rep")).alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
    return common.unionAll(alone)


def conversation_trie(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", heads: int | None = HEADS, most: int = MOST_HEAD, cells: int | None = None) -> DataFrame:
    """The trie of a table of turns; with ``heads``, of the conversations rebuilt by ``with_shared_heads``. See ``ordered_turns`` and ``trie`` for the cases."""
    turns = stored(ordered_turns(table, conv_col, turn_col, role_col, text_col), "ordered")
    convs = turns.select("conv_id").distinct()
    return trie(convs, with_shared_heads(turns, heads, most) if heads else own_turns(turns), cells)
