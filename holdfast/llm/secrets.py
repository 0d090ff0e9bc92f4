"""Secrets in texts, and how widely each one is spread. DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import stored, text_of

#: The patterns of the base kinds. Letters of the names may have either case. Runs of letters are taken whole, so
#: a least length can stand in the pattern for access keys and hex; for assignments a short value still uses up its text.
ASSIGN = (
    "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]+"
)
ASSIGN_VALUE = "^[A-Za-z_]+[\"']?\\x20*[:=]\\x20*[\"']?"
LEAST_VALUE = 6
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: Kinds that the method adds: tokens with a vendor's prefix, and keys in armour.
ISSUED = "(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})"
ARMOUR = "-----BEGIN [A-Z ]*PRIVATE KEY-----"
BASE_KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
ADDED_KINDS = {"issued": ISSUED, "armour": ARMOUR}

#: Plain strings of which a text must hold one to have a match at all; looking for them is far cheaper than the pattern.
NEEDED = {"assign": ":=", "access": ["AKIA"], "issued": ["_", "xox"], "armour": ["-----BEGIN"]}

#: A value in the texts of more owners than this is a copied example, not anyone's credential.
MAX_OWNERS = 2
MAX_REPOSITORIES = 2
#: Words that make a value a placeholder, whoever has it.
PLACEHOLDER = "(?i)example|changeme|change_me|dummy|sample|placeholder|your[_-]|x{6,}|0{8,}|1234567|abcdefg"

_SPAN = "struct<kind: string, start: int, end: int, value: string>"


#: Matches whose places are summed up at once. An array grows by copying, so long lists of matches are summed in pieces, and then the pieces.
PIECE = 128


def _pairs(found: Column, gaps: Column) -> Column:
    """The matches, each with the length of the text between the one before and it."""
    gap = F.transform(F.slice(gaps, 1, F.size(found)), lambda g: F.length(g))
    none = F.array().cast("array<struct<gap: int, match: string>>")
    return F.when(F.size(found) > 0, F.arrays_zip(gap.alias("gap"), found.alias("match"))).otherwise(none)


def _piece(pairs: Column, number: Column) -> Column:
    return F.slice(pairs, number * PIECE + 1, F.lit(PIECE))


def _numbers(pairs: Column) -> Column:
    """The numbers of the pieces."""
    return F.when(F.size(pairs) > 0, F.sequence(F.lit(0), ((F.size(pairs) - 1) / PIECE).cast("int"))).otherwise(F.array().cast("array<int>"))


def _lengths(pairs: Column) -> Column:
    """How much of the text each piece covers."""
    return F.transform(_numbers(pairs), lambda i: F.aggregate(_piece(pairs, i), F.lit(0), lambda at, p: at + p["gap"] + F.length(p["match"])))


def _starts(lengths: Column) -> Column:
    """Where each piece begins."""
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(lengths, first, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def _places(kind: str, pairs: Column, starts: Column) -> Column:
    """Places of the matches. The pieces between the matches and the matches themselves, taken in turn, are the text;
    so running sums of their lengths are the places, in code points."""
    none = F.array().cast(f"array<{_SPAN}>")

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + pair["gap"]
        end = start + F.length(pair["match"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), pair["match"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def piece(p: Column) -> Column:
        return F.aggregate(_piece(pairs, p["i"]), F.struct(p["at"].alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    # The starts are an argument, not a part of the function: there they would be computed anew for each piece.
    return F.flatten(F.transform(F.arrays_zip(_numbers(pairs).alias("i"), starts.alias("at")), piece))


def _in_order(spans: Column, kinds: list[str]) -> Column:
    """By start, then by kind as listed."""
    rank = F.create_map(*[F.lit(x) for pair in zip(kinds, range(len(kinds))) for x in pair])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    return F.array_sort(keyed)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_base`` and ``_added``: arrays of (start, rank, kind, end, value), in order. A missing text counts as empty.

    The value of an assignment is what follows the sign; values are never shortened. No shuffle.
    """
    text = text_of(text_col)
    patterns = {**BASE_KINDS, **ADDED_KINDS}
    names = [*patterns]

    def matches(kind: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(patterns[kind]), F.lit(0))
        hints = [F.contains(text, F.lit(x)) for x in NEEDED.get(kind, ())]
        return F.when(reduce(or_, hints), found).otherwise(F.array().cast("array<string>")) if hints else found

    # Step by step, so that a pattern runs once over a text; and once more, for the gaps, where it has matched.
    with_matches = docs.select("*", *[matches(k).alias(f"_{k}_found") for k in names])
    paired = with_matches.select("*", *[_pairs(F.col(f"_{k}_found"), F.split(text, patterns[k], -1)).alias(f"_{k}_pairs") for k in names])
    measured = paired.select("*", *[_lengths(F.col(f"_{k}_pairs")).alias(f"_{k}_lengths") for k in names])
    started = measured.select("*", *[_starts(F.col(f"_{k}_lengths")).alias(f"_{k}_starts") for k in names])
    with_kinds = started.select("*", *[_places(k, F.col(f"_{k}_pairs"), F.col(f"_{k}_starts")).alias(f"_{k}_spans") for k in names])

    def value(s: Column) -> Column:
        return F.regexp_replace(s["value"], ASSIGN_VALUE, "")

    assigned = F.transform(
        F.col("_assign_spans"), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), value(s).alias("value"))
    )
    assigned = F.filter(assigned, lambda s: F.length(s["value"]) >= LEAST_VALUE)
    base = _in_order(F.concat(assigned, F.col("_access_spans"), F.col("_hex_spans")), names)
    added = _in_order(F.concat(F.col("_issued_spans"), F.col("_armour_spans")), names)
    return with_kinds.select(*docs.columns, base.alias("_base"), added.alias("_added"))


def sealed(spans: Column) -> Column:
    """Spans with the hash of their value in its place, and whether it is a placeholder: what may be written down."""
    return F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash"), F.lower(s["value"]).rlike(PLACEHOLDER).alias("placeholder")),
    )


def spread(found: DataFrame, owner_col: str = "source", repository_col: str = "source") -> DataFrame:
    """One row per hash of a value: in how many owners' and repositories' texts it occurs, in how many texts, and whether it looks live.

    ``found`` has ``_base`` and ``_added`` as :func:`sealed`. Live: with at most ``MAX_OWNERS`` owners, in at most ``MAX_REPOSITORIES`` repositories, and no placeholder. Counting goes by
    (value, owner, repository) first, so a value that is copied everywhere shrinks in the partial aggregate. A missing owner or repository counts as one more.
    """
    each = found.select(F.col(owner_col).alias("owner"), F.col(repository_col).alias("repository"), F.explode(F.concat("_base", "_added")).alias("s"))
    each = each.select("owner", "repository", "s.hash", "s.placeholder")
    by_place = each.groupBy("hash", "owner", "repository").agg(F.count("*").alias("uses"), F.max("placeholder").alias("placeholder"))
    part = ["hash", "uses", "placeholder"]
    # Owners and repositories are told apart one after the other, each by an aggregate over what the one before has left.
    owners = by_place.groupBy("hash", "owner").agg(F.sum("uses").alias("uses"), F.max("placeholder").alias("placeholder")).select(*part, F.lit(1).alias("o"), F.lit(0).alias("r"))
    repositories = by_place.groupBy("hash", "repository").agg(F.max("placeholder").alias("placeholder")).select("hash", F.lit(0).cast("bigint").alias("uses"), "placeholder", F.lit(0).alias("o"), F.lit(1).alias("r"))
    by_hash = owners.unionAll(repositories).groupBy("hash").agg(
        F.sum("o").alias("n_owners"), F.sum("r").alias("n_repositories"), F.sum("uses").alias("n_uses"), F.max("placeholder").alias("placeholder")
    )
    live = (F.col("n_owners") <= MAX_OWNERS) & (F.col("n_repositories") <= MAX_REPOSITORIES) & ~F.col("placeholder")
    return by_hash.select("hash", "n_owners", "n_repositories", "n_uses", live.alias("live"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str = "source") -> DataFrame:
    """One row per document: counts and digest of the base spans, all spans, and those that look live.

    Columns: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied (spans whose value many owners or repositories have), live_spans. Rows are
    told apart by id and text: repeated rows give equal results. A missing text counts as empty, a missing owner as an owner of
    its own kind, a missing id stays missing. An empty table gives no rows.

    Texts are read once and never shuffled. What was found in them is written to the shared working folder, since three steps need it: places and hashes, never the values; then only candidates move.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"), F.col(owner_col).alias("owner"), F.col(repository_col).alias("repository"))
    found = find_secrets(source).select("doc_id", F.xxhash64("text").alias("_text"), "owner", "repository", sealed(F.col("_base")).alias("_base"), sealed(F.col("_added")).alias("_added"))
    keyed = stored(found, "secrets")
    counts = spread(keyed, "owner", "repository")
    spans = keyed.where((F.size("_base") > 0) | (F.size("_added") > 0)).select("doc_id", "_text", F.explode(F.concat("_base", "_added")).alias("s"))
    spans = spans.select("doc_id", "_text", "s.start", "s.rank", "s.kind", "s.end", "s.hash")
    judged = spans.distinct().join(counts, "hash")
    by_doc = judged.groupBy("doc_id", "_text").agg(
        F.count_if("live").alias("n_live"),
        F.count_if((F.col("n_owners") > MAX_OWNERS) | (F.col("n_repositories") > MAX_REPOSITORIES)).alias("n_copied"),
        F.array_sort(F.collect_list(F.when(F.col("live"), F.struct("start", "rank", "kind", "end")))).alias("_live"),
    )

    def of_kind(kind: str) -> Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    rows = keyed.select(
        "doc_id",
        "_text",
        *[of_kind(k) for k in BASE_KINDS],
        F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("_base", "_added"))).alias("spans"),
    )
    none = F.array().cast("array<struct<start: int, rank: int, kind: string, end: int>>")
    by_doc = by_doc.select(F.col("doc_id").alias("_id"), F.col("_text").alias("_of"), "n_live", "n_copied", _joined(F.coalesce("_live", none)).alias("live_spans"))
    # Documents without any span are most of them and match nothing: they need not meet in the join.
    bare = rows.where(F.col("spans") == "").select("*", F.lit(0).cast("bigint").alias("n_live"), F.lit(0).cast("bigint").alias("n_copied"), F.lit("").alias("live_spans"))
    full = rows.where(F.col("spans") != "")
    same = full["doc_id"].eqNullSafe(by_doc["_id"]) & (full["_text"] == by_doc["_of"])
    columns = ["doc_id", *[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans", "n_live", "n_copied", "live_spans"]
    return full.join(by_doc, same).select(*columns).unionAll(bare.select(*columns))
