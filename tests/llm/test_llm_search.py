"""Hard negatives, benchmark passages and the prefix trie, against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from holdfast.llm import decontamination, hard_negatives, prefix_trie
from holdfast.llm.decontamination import build_index, contamination, find_passages, words_of
from holdfast.llm.hard_negatives import Lists, mine
from holdfast.llm.prefix_trie import conversation_trie

VECTORS = "vec_id bigint, embedding array<float>, label int, id string, tie string, q string, block int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", "y", "z", 1) for i, v, y in rows], VECTORS)


def brute_negatives(rows):
    kept = []
    for i, v, y in rows:
        if i is None or v is None or y is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (i, (y + 1) % 10 if i % 7 == 0 else y, tuple(math.floor(256 * float(np.float32(x))) for x in v))
        if row not in kept:
            kept.append(row)
    out = set()
    for a in (r for r in kept if r[0] % 100 == 0):
        scored = [(-sum(x * y for x, y in zip(a[2], r[2])), r[0], r[1]) for r in kept if r is not a and len(r[2]) == len(a[2])]
        for p, j, _ in sorted(s for s in scored if s[2] == a[1])[:5]:
            inside = sorted(s for s in scored if s[2] != a[1] and 30 * -p <= 100 * -s[0] <= 90 * -p)[:10]
            out |= {(a[0], j, k, s[1], -p, -s[0]) for k, s in enumerate(inside, 1)}
    return out


def mined(df):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(df, label=moved)


def hostile_vectors():
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.3, 6).tolist(), int(rng.integers(0, 3))) for i in range(700)]
    rows += [(1000 + i, [0.25] * 6, 1) for i in range(120)]  # copies: ties by id
    rows += [(1200, [0.0] * 6, 1), (1300, [0.5] * 3, 1), (1301, [0.4] * 3, 1), (1302, [0.2] * 3, 2), (1400, [], 1), (1401, [], 1), (1402, [], 2)]
    rows += [(1500, None, 1), (1501, [None] * 6, 1), (1502, [float("nan")] * 6, 2), (1503, [float("inf")] * 6, 2), (None, [1.0] * 6, 1), (1600, [0.3] * 6, None)]
    rows += [(100, rows[100][1], rows[100][2]), (1700, [-0.9, 0.0, 0.0, 0.0, 0.0, 0.1], 0), (1701, [3e4] * 6, 0), (1800, [1e5] * 6, 0), (1802, [2e4] * 6, 1)]
    return rows


def test_hard_negatives(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAST_BLOCK", 50)
    monkeypatch.setattr(hard_negatives, "CANDIDATES", 200)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 5)
    rows = hostile_vectors()
    got = [tuple(r) for r in mined(vectors_of(spark, rows)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_negatives(rows)


def test_hard_negatives_of_huge_numbers_are_exact(spark):
    rows = [(100, [1e9, 1.0], 1), (1, [1e9, 3.0], 1), (2, [6e8, 5.0], 2), (3, [6e8, 4.0], 2), (4, [1e300, 1.0], 2)]
    df = vectors_of(spark, rows).withColumn("embedding", F.col("embedding").cast("array<double>"))
    got = mined(df).orderBy("positive_id", "rank").collect()
    assert [(r["positive_id"], r["negative_id"]) for r in got] == [(1, 2), (1, 3)]
    assert all(r["negative_score"] == 2**63 - 1 for r in got)


def test_hard_negatives_of_an_empty_table(spark):
    assert mined(vectors_of(spark, []).limit(0)).collect() == []


def test_the_threshold_stops_early_and_loses_no_tie():
    rng = np.random.default_rng(0)
    vectors = np.floor(rng.normal(0, 5, (4000, 2)))
    vectors[:300] = 40  # as good as the best, many times
    ids = rng.permutation(4000).astype(np.int64)
    block = Lists(ids, np.zeros(4000, np.int64), np.zeros(4000, np.int64), vectors)
    anchor = np.array([1.0, 1.0])
    read = []

    def counted(a):
        for rows, scores, bound in Lists.scored(block, a):
            read.append(len(rows))
            yield rows, scores, bound

    block.scored = counted
    rows, scores = block.best(anchor, -1, 0, 0, 5)
    assert block.ids[rows].tolist() == sorted(ids[:300].tolist())[:5] and set(scores) == {80.0}
    assert sum(read) < 1000


DOCS = "doc_id bigint, text string, segment string, ids string, place int"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_passages(docs, items, window=10):
    out = []
    for i, text in docs:
        found, hit, doc = set(), set(), words(text)
        for item, passage in items:
            w = words(passage)
            n = min(window, len(w))
            for k in range(len(w) - n + 1 if n else 0):
                for s in range(len(doc) - n + 1):
                    if doc[s : s + n] == w[k : k + n]:
                        hit |= set(range(s, s + n))
                        found |= {str(item)} - {"None"}
        out.append((i, len(doc), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0))
    return sorted(out, key=str)


def passages():
    rng = random.Random(5)
    vocab = ["the", "a", "Of", "straße", "x1", "日本", "run", "ran", "cat", "Ünder"] + [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([3, 9, 10, 12, 25])))) for i in range(12)]
    items += [(20, None), (21, ""), (22, "... !"), (23, items[0][1]), (23, items[0][1]), (24, "the"), (25, "zz " * 14)]
    docs = []
    for i in range(60):
        text = " ".join(rng.choices(vocab, k=rng.randint(0, 200)))
        for _ in range(rng.randint(0, 2)):
            text += rng.choice([", ", "\n", "\x00", "-"]) + (items[rng.randrange(12)][1]).upper().replace("SS", "ß").replace("Ü", "Ü") + " "
        docs.append((i, text))
    docs += [(70, None), (71, ""), (72, " .,"), (73, "zz-" * 500), (74, items[3][1]), (74, items[3][1]), (None, items[4][1]), (75, "w1 " * 300_000 + items[5][1])]
    # A passage may not reach from one document into the next.
    half = items[6][1].split()
    docs += [(80, " ".join(half[: len(half) // 2])), (81, " ".join(half[len(half) // 2 :]))]
    return docs, items


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "s", "t", 1) for i, t in rows], DOCS).repartition(1)


@pytest.mark.parametrize("block", [100_000, 7])
def test_passages(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK", block)
    monkeypatch.setattr(decontamination, "SEGMENT", 3000)
    docs, items = passages()
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, words string")
    got = contamination(docs_of(spark, docs), bench).collect()
    assert sorted((tuple(r) for r in got), key=str) == [tuple(r) for r in brute_passages(docs, items)]


def test_no_passages_in_nothing(spark):
    empty = docs_of(spark, []).limit(0)
    bench = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert contamination(empty, bench).collect() == []
    got = contamination(docs_of(spark, [(1, "a b"), (2, None)]), bench.limit(0)).collect()
    assert [(r["doc_id"], r["n_words"], r["n_items"], r["contaminated"]) for r in got] == [(1, 2, 0, False), (2, 0, 0, False)]


def test_near_passages(spark):
    """Each word at most ``slack`` places from where the window has it, from some start."""
    rng = random.Random(2)
    vocab = [f"v{i}" for i in range(8)]
    docs = [(i, " ".join(rng.choices(vocab, k=60))) for i in range(40)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([4, 6])))) for i in range(30)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for slack in (0, 1, 2):
        found = find_passages(build_index(docs_of(spark, docs)), bench, window=5, slack=slack)
        got = {r["doc_id"]: sorted(r["near"]) for r in found.collect()}
        for i, text in docs:
            doc, want = words(text), set()
            for item, passage in items:
                w = words(passage)
                for k in range(max(1, len(w) - 4)):
                    part = w[k : k + 5]
                    if any(all(part[o] in doc[max(0, s + o - slack) : s + o + slack + 1] for o in range(len(part))) for s in range(-slack, len(doc) + slack)):
                        want.add(str(item))
            assert got[i] == sorted(want), (slack, i)
    with pytest.raises(ValueError):
        find_passages(build_index(docs_of(spark, docs)), bench, slack=40)


def test_words_of_texts_of_a_slice():
    texts = pa.array(["x", "Ab c", None, "", "1é-É2", "a\x00b\x7fc", "end"])
    got, lengths = words_of(texts.slice(1, 5))
    assert got.to_pylist() == ["ab", "c", "1é", "É2", "a", "b", "c"] and lengths.tolist() == [2, 0, 0, 2, 3]


TURNS = "conv_id bigint, turn bigint, role string, text string, pos int, chunk string, rep int"


def brute_trie(rows, heads=20):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, path in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, int(c - math.fmod(c, heads)) if heads else c
        built[c] = own.get(base, [])[:h] + path[h:] if heads else path
    nodes = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below)]
        saved = sum((len(nodes[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def hostile_turns():
    rng = random.Random(9)
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi there", "a  b\tc", "", None, "ok", f"only {c}"])))
    rows += [(c, t, "user", f"same {t} words") for c in range(100, 140) for t in range(5)]  # copies of one conversation
    rows += [(200, t, "u", "long") for t in range(300)] + [(220, t, "u", "long") for t in range(150)]
    rows += [(300, None, "u", "first"), (300, 0, "u", "second"), (300, None, None, None), (301, 1, "u", "x"), (301, 1, "u", "x"), (None, 1, "u", "lost"), (-7, 0, "u", "neg"), (-7, 1, "u", "neg"), (-7, 2, "u", "neg"), (-7, 3, "u", "neg")]
    rows += [(400, 0, "a", "b:c"), (401, 0, "a:", "bc"), (402, 0, "", "ab:c")]
    return rows


@pytest.mark.parametrize("cells", [None, 64])
@pytest.mark.parametrize("heads", [20, None])
def test_trie(spark, cells, heads):
    """A sketch of 64 cells takes nearly everything for shared: the result is the same."""
    rows = hostile_turns()
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], TURNS)
    got = [tuple(r) for r in conversation_trie(df, heads=heads, cells=cells).collect()]
    assert sorted(got, key=str) == brute_trie(rows, heads)


def test_trie_of_few_turns(spark):
    empty = spark.createDataFrame([], TURNS)
    assert conversation_trie(empty).collect() == []
    one = [(20, 0, "u", "a b")]
    got = conversation_trie(spark.createDataFrame([(*r, 1, "x", 2) for r in one], TURNS)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_trie(one)


def test_a_long_list_of_ends_is_hashed_in_order(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS_EACH", 7)
    rows = [(c, 0, "u", "x") for c in range(-50, 400)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], TURNS)
    got = [tuple(r) for r in conversation_trie(df, heads=None).collect()]
    assert sorted(got, key=str) == brute_trie(rows, None)


def test_the_sketch_proves_singles(spark):
    """No shared prefix is taken for a single one, and in a wide sketch nearly all single ones are seen."""
    p = [(i, i * 7919 + 1) for i in range(3000)] + [(i, i * 7919 + 1) for i in range(100)]
    df = spark.createDataFrame(p, "p1 bigint, p2 bigint")
    width = 1 << 16
    table = prefix_trie.sketch(df, width)
    a, b = (np.array(x, np.int64) for x in zip(*p[:3000]))
    shared = prefix_trie._shared(table, a, b, width)
    assert shared[:100].all() and shared[100:].sum() < 60
