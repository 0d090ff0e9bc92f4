"""The pipeline against plain Python: the same decisions, stage by stage, by brute force."""

import re
from itertools import combinations

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from holdfast.llm import language, mixing
from holdfast.llm.language_query import learned

SF = "/root/testdata/sf0.001"


def grams(text):
    words = re.findall(r"\w+", text.lower())
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_run_matches_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r["doc_id"]: r for r in language.identify(docs, learned(docs)).collect()}
    rows = {r["doc_id"]: r for r in docs.collect() if found[r["doc_id"]]["lang_pred"] != "und" and found[r["doc_id"]]["share"] >= 0.5}

    groups = {}
    for i, r in rows.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r["text"]), []).append(i)
    left = sorted(min(g, key=lambda i: (-len(rows[i]["text"]), i)) for g in groups.values())

    sets, root = {i: grams(rows[i]["text"]) for i in left}, {i: i for i in left}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(left, 2):
        both = len(sets[a] & sets[b])
        if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    left = [i for i in left if find(i) == i]

    kept = docs.where(docs["doc_id"].isin(left))
    uses = {r["doc_id"]: r["epochs"] + (r["part"] > 0) for r in mixing.mix(kept, whole_docs=True).collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((i, library.encode(rows[i]["text"], add_special_tokens=False).ids) for i in left for _ in range(uses[i]))
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], list(r["ids"])) for r in got) == want
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in got)


def test_stages_take_odd_rows(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept int, ids string"
    texts = [None, "", "  ", "12", "the and of that", "the and of that", "the  and of that", "x " * 50_000, "der und die keit"]
    rows = [(None if i == 8 else i % 7, t, None if i % 2 else "en", None if i == 4 else "s", None, 1, "y") for i, t in enumerate(texts)]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "bpe":
                assert out.columns == docs.columns
            docs = out
        docs.collect()
