"""Mixing sources to target weights: whole epochs first, then a weighted sample without replacement up to the budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.common import WORD, fresh, stored, text_of
from holdfast.operators.joins import join_unique
from holdfast.operators.ordering import running_totals

#: Weights that the sources take in turn, share of all words that the mix takes, and how often a document is used at most.
WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MAX_EPOCHS = 2
#: Cells of a source's key range. Only the cell in which the budget ends is sorted.
CELLS = 4096


def quality(text: Column) -> Column:
    """Weight of a document in the sample: its share of letters and white space, 0.05 to 1."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\x20\x09-\x0D]+", ""))
    return F.greatest(F.lit(0.05), letters / F.greatest(F.length(text), F.lit(1)))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = TOTAL_SHARE, most: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, ...) with ``target`` added: ``share`` of all words by weight, none above ``most`` times its size.

    Handing the excess on by weight until none is above ends at one level L, with target = min(most * size, L * weight). Sources
    are full in the order of size / weight; L follows from the first source that is not. One row per source is sorted in one task.
    """
    in_turn = F.array(*[F.lit(float(w)) for w in weights])
    place = Window.orderBy(F.col("source").isNull(), "source")
    listed = sizes.select("source", *sizes.columns[1:], F.get(in_turn, F.pmod(F.row_number().over(place) - 1, F.lit(len(weights)))).alias("weight"))
    listed = listed.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(whole) * F.lit(float(share))
    left = total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    ranked = listed.select("*", (left / F.sum("weight").over(after)).alias("_level"))
    # The level if this source and all later ones are not full. The first that it leaves below its cap has the right one, and the highest:
    # each later one takes a cap off that is more than the source's share.
    level = F.max(F.when(F.col("_level") * F.col("weight") < F.col("_cap"), F.col("_level"))).over(whole)
    target = F.when(level.isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), level * F.col("weight")))
    return ranked.select(*sizes.columns, target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 20, whole_docs: bool = False) -> DataFrame:
    """One row per document: doc_id, source, text_hash, size, source_size, target, taken, epochs (whole uses), part (words of the last, partial use).

    Each source first takes all its documents ``floor(target / size)`` times. The rest of its budget goes to documents in the order
    of Efraimidis-Spirakis keys, -ln(u) / quality with u from a hash of seed, id and text: their sizes are summed up in that order until the
    budget is used. The last document gives only its first words, so that the source meets its target; with ``whole_docs`` it is taken whole if
    more than half of it fits, and else left. Reruns agree, as nothing but the rows decides.

    A missing text has size 0; documents of size 0 are never taken. Documents without a source form one source, the last. Rows with
    the same id and text get one key; ties are taken together and share what is left of the budget, rounded down. Other columns are not read. An empty
    table gives no rows.

    Texts are read once. Keys are exponential over quality, so 1 - exp(-key) cuts them into ``CELLS`` cells; sums per cell, made before
    the shuffle, tell the cell in which the budget ends, and only its documents are put in order. Documents of low quality crowd the last cells, so a cell may hold much of a source: it is
    summed up in pieces of its range, whose cuts come from the keys themselves.
    """
    text = text_of(text_col)
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), text), 11)
    chance = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    sized = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.col(source_col).alias("source"),
        # The same as a name that is never missing, for joins.
        F.when(F.col(source_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(source_col))).alias("of"),
        F.xxhash64(text).alias("text_hash"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"),
        (-F.log(chance) / quality(text)).alias("key"),
    )
    cell = F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * F.lit(CELLS)).cast("int")
    rows = stored(sized.withColumn("cell", F.least(cell, F.lit(CELLS - 1))), "mix")

    cells = rows.groupBy("source", "of", "cell").agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
    totals = cells.groupBy("source", "of").agg(F.sum("words").alias("source_size"), F.sum("docs").alias("_rows"))
    budget = targets(totals).drop("source")
    share = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-12))).otherwise(F.lit(0))
    budget = budget.select("of", "source_size", "_rows", "target", share.cast("bigint").alias("epochs"))
    # Rounded down, so that no source goes above its target.
    budget = budget.withColumn("rest", F.greatest(F.lit(0), F.floor(F.col("target") + F.lit(1e-6)).cast("bigint") - F.col("epochs") * F.col("source_size")))

    running = Window.partitionBy("of").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = cells.join(budget, "of").select("of", "cell", "rest", F.sum("words").over(running).alias("sum"), "words")
    ends = reach.where((F.col("sum") > F.col("rest")) & (F.col("sum") - F.col("words") <= F.col("rest")) & (F.col("words") > 0))
    ends = ends.groupBy("of").agg(F.min(F.struct(F.col("cell"), (F.col("rest") - F.col("sum") + F.col("words")).alias("room"))).alias("e"))
    planned = stored(budget.drop("rest").join(ends.select("of", F.col("e.cell").alias("end_cell"), F.col("e.room").alias("room")), "of", "left"), "mix-plan")

    # One row per source: small beside the documents, but without a known bound. A source may hold most documents, so large ones are spread.
    placed = join_unique(rows, planned.drop("_rows"), "of", counts=planned.select("of", "_rows"))
    inside = placed.where(F.col("cell") == F.col("end_cell"))
    by_key = inside.groupBy("of", "key").agg(F.sum("size").alias("words"), F.first("room").alias("room"), F.count_if(F.col("size") > 0).alias("ties"))
    # However many documents a cell holds, they are summed up in pieces of the key's range.
    summed = running_totals(by_key, "key", ["words"], ["of"])
    filled = summed.select("of", "key", "words", "ties", (F.col("room") - F.col("cum_words") + F.col("words")).alias("room_here"))
    if whole_docs:
        use = F.when(F.col("room_here") * 2 > F.col("words"), F.col("words")).otherwise(F.lit(0))
    else:
        use = F.greatest(F.lit(0), F.least(F.col("words"), F.col("room_here")))
    used = filled.select("of", "key", (use / F.greatest(F.lit(1), F.col("ties"))).cast("bigint").alias("use"))
    cut = inside.join(used, ["of", "key"])
    columns = ["doc_id", "source", "text_hash", "size", "source_size", "target", "epochs"]
    outside = placed.where(F.col("end_cell").isNull() | (F.col("cell") != F.col("end_cell")))
    early = F.when(F.col("cell") < F.col("end_cell"), F.col("size")).otherwise(F.lit(0))
    parts = cut.select(*columns, F.least("use", "size").alias("part")).unionAll(outside.select(*columns, early.cast("bigint").alias("part")))
    return parts.select(
        "doc_id", "source", "text_hash", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"), "epochs", "part"
    )


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 20) -> DataFrame:
    """The mix itself: each document as many times as it is taken, whole, with all its columns."""
    doc, of, n, digest, use = fresh(docs, "_id", "_of", "_n", "_hash", "_use")
    uses = mix(docs, id_col, text_col, source_col, seed, whole_docs=True)
    times = F.max(F.col("epochs") + F.when(F.col("part") > 0, 1).otherwise(0)).alias(n)
    uses = uses.groupBy(F.col("doc_id").alias(doc), F.col("text_hash").alias(of)).agg(times).where(F.col(n) > 0)
    # Documents of size 0 add no words and are not taken.
    keyed = docs.withColumn(digest, F.xxhash64(text_of(text_col))).where(F.regexp_like(text_of(text_col), F.lit(WORD)))
    joined = keyed.join(uses, keyed[id_col].cast("bigint").eqNullSafe(uses[doc]) & (keyed[digest] == uses[of]))
    return joined.withColumn(use, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
