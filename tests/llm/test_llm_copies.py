"""Exact copies, near copies of texts, near copies of vectors, and components, against brute force."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest

from holdfast.llm import jaccard
from holdfast.llm.components import components, forest
from holdfast.llm.embeddings import Index, near_duplicates
from holdfast.llm.exact_dedup import exact_groups, keep_exact
from holdfast.llm.jaccard import keep_one, near_copies, runs_for, shingles

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, keep_id string, _id int, n int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", 1, 2) for i, t in rows], DOCS)


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


EXACT = [(1, "a b c"), (2, "a  b c"), (3, "abc"), (4, "ABC"), (5, None), (6, ""), (7, " \t\n"), (8, "x" * 200_000), (9, "x" * 200_000 + " "), (10, "a b"), (11, "ab"), (12, "ä b"), (12, "ä b"), (None, "ä  b"), (None, "only")]


def test_exact_groups(spark):
    got = sorted((tuple(r) for r in exact_groups(docs_of(spark, EXACT)).collect()), key=str)
    want = []
    for i, t in EXACT:
        group = [(j, u or "") for j, u in EXACT if plain(u) == plain(t)]
        keep, text = min(group, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))
        kept = i == keep and len(t or "") == len(text)
        want.append((i, keep, len(group), kept, hashlib.sha256(plain(t).encode()).hexdigest(), len(t or "")))
    assert got == sorted(want, key=str)


def test_keep_exact_keeps_one_of_each_group_with_its_columns(spark):
    docs = docs_of(spark, EXACT)
    kept = keep_exact(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(plain(r["text"]) for r in rows) == sorted({plain(t) for _, t in EXACT})


@pytest.mark.parametrize("run", [exact_groups, keep_exact, near_copies, keep_one])
def test_empty_table(spark, run):
    assert run(docs_of(spark, []).limit(0)).collect() == []


def brute(rows, least=0.8):
    def grams(text):
        words = re.findall(r"\w+", (text or "").lower())
        return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()

    ids = sorted({i for i, _ in rows if i is not None})
    sets = {}
    for i, t in rows:
        sets.setdefault(i, grams(t))
    links, root = dict.fromkeys(ids, 0), {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(ids, 2):
        both = len(sets[a] & sets[b])
        if both and both >= least * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (links[i], find(i), find(i) == i) for i in ids}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_copies_match_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(500)]
    rows, number = [], 0
    passage = rng.choices(vocabulary, k=60)  # shared by many, alike to none
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.randint(20, 400))
        for edits in (0, 0, 1, 1, 2, 4, 8):
            rows.append((number, edited(rng, base, edits)))
            number += 1
        rows.append((number, " ".join(passage + rng.choices(vocabulary, k=120))))
        number += 1
    rows += [(number, None), (number + 1, ""), (number + 2, "!!"), (number + 3, "one two"), (number + 4, "One, two"), (number + 5, "one two"), (number + 5, "one two"), (None, "one two")]
    rows.append((number + 6, " ".join(rng.choices(vocabulary, k=60_000))))
    got = near_copies(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    wrong = [(r, want[r["doc_id"]]) for r in got if r["doc_id"] is not None and (r["n_links"], r["component_id"], r["kept"]) != want[r["doc_id"]]]
    assert wrong == []
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(0, None, True)]


def test_a_large_group_of_near_copies_is_split_and_whole(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET", 16)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = random.Random(5)
    base = rng.choices([f"v{i}" for i in range(300)], k=150)
    rows = [(i, edited(rng, base, rng.randint(0, 3))) for i in range(150)]
    want = brute(rows)
    got = near_copies(docs_of(spark, rows)).collect()
    # Workers have the module's own sizes; the plan has these. Every pair of blocks meets once.
    assert {r["doc_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == want
    kept = keep_one(docs_of(spark, rows))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, x in want.items() if x[2]}
    assert len(kept.columns) == 9


def test_runs_follow_from_the_recall():
    assert runs_for(0.9) < runs_for(0.99) < runs_for(0.9999)
    assert (jaccard.lost(2) ** runs_for(0.9999)) <= 1e-4


def test_pairs_in_large_buckets_are_candidates():
    rng = np.random.default_rng(6)
    pairs = 20_000
    low = rng.integers(0, 2**32, (2 * pairs, jaccard.MINIMA), dtype=np.uint32)
    equal = rng.random((pairs, jaccard.MINIMA)) < jaccard.LEAST
    low[1::2][equal] = low[::2][equal]
    doc, _, above, deep = jaccard.paths(low, runs_for(jaccard.RECALL))
    seen = np.unique(np.stack([doc[above].astype(np.uint64), deep]), axis=1)
    _, times = np.unique(np.stack([seen[0] // np.uint64(2), seen[1]]), axis=1, return_counts=True)
    owner = np.unique(np.stack([seen[0] // np.uint64(2), seen[1]]), axis=1)[0]
    met = np.zeros(pairs, bool)
    met[owner[times == 2].astype(int)] = True
    met &= (low[::2].astype(np.uint8) == low[1::2].astype(np.uint8)).mean(axis=1) >= jaccard.SKETCH
    # Two are expected at a recall of 0.9999.
    assert (~met).sum() <= 8


def test_shingles_do_not_depend_on_case_or_marks():
    known = jaccard._Hashes()
    assert (shingles("The quick, brown FOX jumps over", known) == shingles("the QUICK brown fox; jumps over!", known)).all()
    assert len(shingles("a b c d e f", known)) == 2 and len(shingles("a b", known)) == 1 and len(shingles(None, known)) == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (500, 501), (501, 500)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 500: 500, 501: 500}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_forest_finds_smallest_ids():
    ids = np.array([50, 3, 9, 7, 1, 8])
    assert forest(ids, (np.array([0, 1, 3]), np.array([1, 2, 5]))).tolist() == [3, 3, 3, 7, 1, 7]


def vectors(rng, groups=12, dim=16):
    rows = []
    for _ in range(groups):
        base = rng.normal(size=dim)
        for scale in (0, 0.05, 0.15, 0.3, 0.5):
            rows.append([float(x) for x in np.float32(base + scale * rng.normal(size=dim))])
    return rows


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(2)
    good = vectors(rng)
    good += [good[0], good[0], [2 * x for x in good[3]]]
    rows = [(i, v) for i, v in enumerate(good)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [1.0, None] + [0.0] * 14), (904, [float("nan")] * 16), (905, [float("inf")] + [0.0] * 15), (906, [1.0, 2.0]), (907, [1.0, 2.0]), (None, good[0])]
    table = spark.createDataFrame([(i, v, 1, "x", 3) for i, v in rows + odd], "vec_id bigint, embedding array<float>, label int, kept string, n int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_duplicates(table).collect()}
    unit = np.array(good) / np.linalg.norm(good, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    root = list(range(len(good)))
    for _ in root:
        root = [min([root[i], *[root[j] for j in np.flatnonzero(near[i])]]) for i in range(len(good))]
    for i in range(len(good)):
        assert got[i] == (int(near[i].sum()), root[i], root[i] == i)
    assert [got[i] for i in (900, 901, 902, 903, 904, 905)] == [(0, i, True) for i in range(900, 906)]
    assert got[906] == (1, 906, True) and got[907] == (1, 906, False) and got[None] == (0, None, True)


def test_no_sound_vector(spark):
    table = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id bigint, embedding array<float>")
    assert sorted(tuple(r) for r in near_duplicates(table).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert near_duplicates(table.limit(0)).collect() == []


@pytest.mark.parametrize("spread", [None, 4.0])
def test_probes_and_codes_lose_nothing(spread):
    rng = np.random.default_rng(1)
    points = np.array(vectors(rng, 200, 24), np.float64)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    index = Index.fit(points[::3], 20)
    lists, codes, errors = index.encode(points)
    radius, found = np.sqrt(0.1), set()
    rows, probed = index.probes(points, radius, spread)
    for number in range(20):
        held, asking = np.flatnonzero(lists == number), rows[probed == number]
        i, j = index.near(points[asking], points[held], number, codes[held], errors[held], radius, 0.95)
        found |= set(zip(asking[i].tolist(), held[j].tolist()))
    want = set(zip(*(x.tolist() for x in np.nonzero(points @ points.T >= 0.95))))
    assert found == want
    assert len(rows) < 20 * len(points)


def stretched(rng, kind, rows=700, dim=32):
    """Vectors near a few directions only, and each with a partner at a cosine just above 0.95."""
    scales = np.where(np.arange(dim) < 3, 1.0, 0.0) if kind == "low rank" else 0.6 ** np.arange(dim)
    base = rng.normal(size=(rows, dim)) * scales
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    way = rng.normal(size=(rows, dim)) * scales
    way -= (way * base).sum(1, keepdims=True) * base
    way /= np.linalg.norm(way, axis=1, keepdims=True)
    return np.concatenate([base, 0.951 * base + np.sqrt(1 - 0.951**2) * way])


@pytest.mark.parametrize("kind", ["low rank", "decaying spectrum"])
def test_no_link_is_lost_where_differences_share_directions(spark, kind, monkeypatch):
    fit = Index.fit.__func__
    monkeypatch.setattr(Index, "fit", classmethod(lambda cls, sample, lists, seed=5: fit(cls, sample, 60, seed)))
    points = stretched(np.random.default_rng(4), kind)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(points)]
    got = {r["vec_id"]: r["n_links"] for r in near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    units = points / np.linalg.norm(points, axis=1, keepdims=True)
    assert [got[i] for i in range(len(points))] == ((units @ units.T >= 0.95).sum(1) - 1).tolist()


def test_keep_one_goes_by_id_and_text(spark):
    """A text is not dropped because another one with its id is a copy; the smallest id of a group stays, repeated rows stay once."""
    base = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, base), (2, base + " x"), (2, other), (3, None), (4, ""), (None, base + " y"), (5, other + " z"), (6, "one of a kind"), (6, "one of a kind")]
    got = sorted(((r["doc_id"], r["text"]) for r in keep_one(docs_of(spark, rows)).collect()), key=str)
    assert got == sorted([(1, base), (2, other), (3, None), (4, ""), (6, "one of a kind")], key=str)
