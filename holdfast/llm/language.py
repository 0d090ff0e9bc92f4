"""Language of texts with mixed languages: candidates by script, scores by word, and the best path through the words."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.common import add_by_text, map_texts

#: First and last code point of the scripts that narrow the candidates.
SCRIPTS = (
    ("latin", 0x0041, 0x024F),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x4DBF),
    ("han", 0x4E00, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
)
UNDETERMINED = "und"
#: About so many documents are learned from, and of each language about ``LANG_DOCS`` where it has them; and the size of the model's tables.
SAMPLE_DOCS = 8_000
LANG_DOCS = 200
MAX_GRAMS = 60_000
MAX_LANGS = 256
#: A language must have this share of its letters in a script to be a candidate there.
MIN_SCRIPT_SHARE = 0.01
#: One word speaks against a language by this much at most (natural log), and a change of language costs this much.
CLIP = 6.0
SWITCH = 9.0
CACHE_WORDS = 300_000
#: Bytes of text whose words a task scores at once; a longer text alone is held whole.
AT_ONCE = 16_000_000

_WORDS = re.compile(r"[^\W\d_]+").findall
_PLACES = re.compile(r"[^\W\d_]+").finditer


def script_of(letter: str) -> str:
    point = ord(letter)
    return next((name for name, low, high in SCRIPTS if low <= point <= high), "other")


@dataclass
class LanguageModel:
    """Log probabilities of letter triples (last row: unknown ones), most frequent language first."""

    langs: list[str]
    grams: dict[str, int]
    logs: np.ndarray
    scripts: dict[str, np.ndarray]  # candidates of each script
    prior: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key: str = "doc_id", limit: int = SAMPLE_DOCS) -> LanguageModel:
    """Learn from the rows with a language and a text; from some ``limit`` of them if there are more, and from ``LANG_DOCS`` of each language at least.

    Rows with the smallest hashes of ``key`` are taken, so reruns and retries agree. The counts are made in Spark; the driver gets ``MAX_GRAMS`` letter
    triples: the most frequent of each language first, then the most frequent of all; for ``MAX_LANGS`` languages, those with most rows.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    total = rows.count()
    sizes = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS)
    part_of = {r["lang"]: min(1.0, max(limit / total, LANG_DOCS / r["n"])) for r in sizes.collect()}
    if part_of:
        # Missing for languages that are not learned.
        taken = F.create_map(*[F.lit(x) for name, share in part_of.items() for x in (name, int(share * 1_000_000_000))])[F.col(lang_col)]
        rows = rows.where(F.pmod(F.xxhash64(key), F.lit(1_000_000_000)) < taken)
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    words = rows.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    counted = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    places = F.sequence(F.lit(1), F.length("word"))
    triples = counted.select("lang", "n", padded.alias("p"), F.explode(places).alias("i"))
    counts = triples.groupBy(F.expr("substring(p, i, 3)").alias("gram"), "lang").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
    by_gram = ranked.groupBy("gram").agg(F.sum("n").alias("total"), F.min("rank").alias("rank"), F.collect_list(F.struct("lang", "n")).alias("by"))
    own = F.col("rank") <= MAX_GRAMS // max(1, len(part_of))
    found = by_gram.orderBy(F.desc(own), F.desc("total"), "gram").limit(MAX_GRAMS).collect()

    of_lang: dict[str, float] = {}
    for row in found:
        for x in row["by"]:
            of_lang[x["lang"]] = of_lang.get(x["lang"], 0) + x["n"] / part_of[x["lang"]]
    langs = sorted(of_lang, key=lambda name: (-of_lang[name], name))
    place = {name: i for i, name in enumerate(langs)}
    table = np.zeros((len(found) + 1, len(langs)))
    scripts: dict[str, np.ndarray] = {}
    for i, row in enumerate(found):
        name = script_of(row["gram"].strip()[:1] or " ")
        shares = scripts.setdefault(name, np.zeros(len(langs)))
        for x in row["by"]:
            if x["lang"] in place:
                table[i, place[x["lang"]]] = x["n"]
                shares[place[x["lang"]]] += x["n"]
    sums = table.sum(axis=0)
    logs = np.log((table + 0.5) / (sums + 0.5 * len(table))).astype(np.float32)
    allowed = {name: shares / np.maximum(sums, 1) >= MIN_SCRIPT_SHARE for name, shares in scripts.items()}
    # As frequent as in the table, not as in the sample.
    whole = sums / np.array([part_of[name] for name in langs])
    prior = np.log(np.maximum(whole, 1) / max(whole.sum(), 1)).astype(np.float32) if langs else np.zeros(0, np.float32)
    return LanguageModel(langs, {row["gram"]: i for i, row in enumerate(found)}, logs, allowed, prior)


class _Words(dict):
    """Numbers of the words met so far; new ones are noted until they are scored."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self) + 1
        self.new.append(word)
        return number


class Scorer:
    """Scores of words by language: at most 0, and 0 for the best. Number 0 stands for a word that says nothing."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.words = _Words()
        self.scores = np.zeros((1, len(model.langs)), np.float32)
        self.letters = np.zeros(1, bool)

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.words.__getitem__, words), np.int32, len(words))

    def settle(self) -> None:
        """Score the words that are new."""
        new, self.words.new = self.words.new, []
        if not new:
            return
        model, get, unknown = self.model, self.model.grams.get, len(self.model.grams)
        blocks, size = [], 0
        start = 0
        for end in range(1, len(new) + 1):
            size += len(new[end - 1])
            if end < len(new) and size < 500_000:
                continue
            part, index, lengths, masks = new[start:end], [], [], []
            for word in part:
                low = word.lower()
                if not low.isalpha():  # numerals that are no digits, and letters that split in lower case
                    low = "".join(c for c in low if c.isalpha())
                padded = f" {low} "
                index.extend([get(padded[i : i + 3], unknown) for i in range(len(low))] or [unknown])
                lengths.append(max(1, len(low)))
                masks.append(script_of(low[0]) if low else "")
            sums = np.add.reduceat(model.logs[np.array(index)], np.cumsum([0, *lengths[:-1]]), axis=0)
            kinds = {name: np.flatnonzero(np.array(masks) == name) for name in set(masks)}
            for name, at in kinds.items():
                candidates = model.scripts.get(name)
                if candidates is None or not candidates.any():
                    sums[at] = 0
                else:
                    sums[np.ix_(at, np.flatnonzero(~candidates))] = -np.inf
            best = sums.max(axis=1, keepdims=True)
            blocks.append(np.maximum(sums - best, -CLIP).astype(np.float32))
            self.letters = np.append(self.letters, [bool(name) for name in masks])
            start, size = end, 0
        self.scores = np.concatenate([self.scores, *blocks])

    def trim(self) -> None:
        if len(self.words) > CACHE_WORDS:
            self.__init__(self.model)


def best_paths(numbers: list[np.ndarray], scores: np.ndarray, prior: np.ndarray, switch: float = SWITCH) -> list[np.ndarray]:
    """The language of every word: the path with the greatest sum of scores less ``switch`` for each change.

    Texts of similar length go through the steps together, so a step is one numpy call for many texts.
    """
    langs = scores.shape[1]
    out: list[np.ndarray] = [np.zeros(len(x), np.int16) for x in numbers]
    order = sorted((i for i in range(len(numbers)) if len(numbers[i])), key=lambda i: -len(numbers[i]))
    cells = max(1, 4_000_000 // max(1, langs))
    at = 0
    while at < len(order):
        steps = len(numbers[order[at]])
        chunk = order[at : at + max(1, cells // steps)]
        at += len(chunk)
        words = np.zeros((steps, len(chunk)), np.int32)
        for j, i in enumerate(chunk):
            words[: len(numbers[i]), j] = numbers[i]
        rows = np.arange(len(chunk))
        came, changed = np.empty((steps, len(chunk)), np.int16), np.empty((steps, len(chunk), langs), bool)
        value = scores[words[0]] + prior
        for t in range(1, steps):
            best = value.argmax(axis=1)
            value = value - value[rows, best][:, None]
            came[t] = best
            np.less(value, -switch, out=changed[t])
            value = np.maximum(value, -switch) + scores[words[t]]
        state = value.argmax(axis=1)
        path = np.empty((steps, len(chunk)), np.int16)
        path[-1] = state
        for t in range(steps - 1, 0, -1):
            state = np.where(changed[t, rows, state], came[t], state)
            path[t - 1] = state
        for j, i in enumerate(chunk):
            out[i] = path[: len(numbers[i]), j]
    return out


def _spans(text: str, path: np.ndarray, langs: list[str]) -> list[dict]:
    cuts = np.flatnonzero(np.diff(path)) + 1
    firsts, lasts = [0, *cuts.tolist()], [*(cuts - 1).tolist(), len(path) - 1]
    wanted = set(firsts) | set(lasts)
    place = {i: m.span() for i, m in enumerate(_PLACES(text)) if i in wanted}
    return [{"lang": langs[path[a]], "start": place[a][0], "end": place[b][1]} for a, b in zip(firsts, lasts)]


def _labeller(model: LanguageModel, docs: DataFrame):
    """What makes the language columns of a batch of texts, and those columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)
        langs, prior = scorer.model.langs, scorer.model.prior

        def run(texts: list) -> list:
            scorer.trim()
            numbers = [scorer.numbers(_WORDS(t) if t and langs else []) for t in texts]
            scorer.settle()
            scores, letters = scorer.scores, scorer.letters
            paths = best_paths(numbers, scores, prior) if langs else numbers
            names, values, shares, counts, spans = [], [], [], [], []
            for text, found, path in zip(texts, numbers, paths):
                known = bool(len(found)) and bool(letters[found].any())
                name, value, share, places = UNDETERMINED, 0.0, 0.0, []
                if known:
                    votes = np.bincount(path, minlength=len(langs))
                    best = int(votes.argmax())
                    total = scores[found].sum(axis=0, dtype=np.float64)
                    odds = np.exp(np.minimum(total - total[best], 50.0)).sum()
                    share = float(votes[best] / len(path))
                    name, value, places = langs[best], share / max(1.0, float(odds)), _spans(text, path, langs)
                names.append(name)
                values.append(value)
                shares.append(share)
                counts.append(len(path) if known else 0)
                spans.append(places)
            return [names, values, shares, counts, spans]

        return run

    span = pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    fields = [
        ("lang_pred", "string", pa.string()),
        ("score", "double", pa.float64()),
        ("share", "double", pa.float64()),
        ("n_words", "bigint", pa.int64()),
        ("spans", "array<struct<lang: string, start: int, end: int>>", pa.list_(span)),
    ]
    return make, fields


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of every whole text: doc_id, lang_pred, score, share, n_words, spans (language, first and last place, in code points).

    The language with most words on the best path wins; ties go to the language that was more frequent in training. ``share`` is its share of the
    words, and the score is that times its probability against the other languages, 0 to 1. A text that is missing or has no letter is ``und`` with
    score 0 and no spans. Words in scripts that no learned language uses count for the language around them. Other columns are not read; repeated rows
    give equal results; an empty table gives no rows. The model is at most ``MAX_GRAMS`` rows, sent to each executor once. No shuffle.
    """
    make, fields = _labeller(model, docs)
    return map_texts(docs, id_col, text_col, make, fields, AT_ONCE)


def keep_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_col: str = "lang", least_share: float = 0.5) -> DataFrame:
    """The documents with a language that holds at least ``least_share`` of their words, with their columns; a missing ``lang_col`` is filled in.

    Texts without a letter are left out.
    """
    make, fields = _labeller(model, docs)
    renamed = [(f"_language_{name}", kind, arrow) for name, kind, arrow in fields]
    found = add_by_text(docs, text_col, make, renamed, most=AT_ONCE).where((F.col("_language_lang_pred") != UNDETERMINED) & (F.col("_language_share") >= least_share))
    filled = F.coalesce(F.col(lang_col), F.col("_language_lang_pred")).alias(lang_col)
    return found.select(*[filled if c == lang_col else F.col(f"`{c}`") for c in docs.columns])
