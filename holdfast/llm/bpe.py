"""Byte-level BPE: merges by a queue of ranks over a linked list of symbols, and decoding by joining vocabulary strings."""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from holdfast.llm.common import add_by_text, map_texts

#: Words whose ids a task keeps; beyond, it starts anew.
CACHE_WORDS = 400_000
#: Symbols that a task keeps in one cached word at most; longer runs are encoded each time.
CACHE_CHARS = 64
#: Bytes of text whose ids a task holds at once; a longer text alone is held whole.
AT_ONCE = 2_000_000


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Bytes that print keep their own character; the others take the next free ones from 256 on, in order.
    """
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, free = [], 256
    for b in range(256):
        letters.append(chr(b) if b in prints else chr(free))
        free += b not in prints
    return letters


class Bpe:
    """A tokenizer read from the text of a tokenizers JSON file (byte-level, no normalizer)."""

    #: Fixed value: how byte-level vocabularies of this family split text before the merges.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, text: str):
        import regex

        spec = json.loads(text)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        letters = byte_letters()
        self.byte_ids = [self.vocab[c] for c in letters]
        byte_of = {c: b for b, c in enumerate(letters)}
        added = spec.get("added_tokens") or []
        self.strings = {i: bytes(byte_of[c] for c in s) for s, i in self.vocab.items() if all(c in byte_of for c in s)}
        self.special = {t["content"]: t["id"] for t in added}
        self.strings.update({i: s.encode() for s, i in self.special.items()})
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.split = regex.compile(self.SPLIT).findall
        longest_first = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None
        self.cache: dict[str, tuple[int, ...]] = {}

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of one piece. Every pair in the list waits in a heap by rank and place; pairs that changed are skipped."""
        ids = [self.byte_ids[b] for b in word.encode()]
        n = len(ids)
        if n < 2:
            return tuple(ids)
        merges = self.merges
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = []
        for i in range(n - 1):
            found = merges.get((ids[i], ids[i + 1]))
            if found:
                queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, merged = heapq.heappop(queue)
            j = after[i] if ids[i] == left else -1
            if j < 0 or ids[j] != right:
                continue  # stale: one of the two has been merged since
            ids[i], ids[j] = merged, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                found = merges.get((merged, ids[k]))
                if found:
                    heapq.heappush(queue, (found[0], i, merged, ids[k], found[1]))
            h = before[i]
            if h >= 0:
                found = merges.get((ids[h], merged))
                if found:
                    heapq.heappush(queue, (found[0], h, ids[h], merged, found[1]))
        return tuple(x for x in ids if x >= 0)

    def _plain(self, text: str, out: list[int]) -> None:
        cache, extend = self.cache, out.extend
        for piece in self.split(text):
            ids = cache.get(piece)
            if ids is None:
                ids = self.word(piece)
                if len(piece) <= CACHE_CHARS:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    cache[piece] = ids
            extend(ids)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        if self.marks is None or not any(s in text for s in self.special):
            self._plain(text, out)
            return out
        for part in self.marks.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                self._plain(part, out)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


def _ids(rows: list[list[int]]) -> pa.ListArray:
    """Lists of ids as one array of 32-bit numbers."""
    offsets = np.cumsum([0, *[len(x) for x in rows]], dtype=np.int32)
    flat = np.empty(int(offsets[-1]), np.int32)
    for start, row in zip(offsets.tolist(), rows):
        flat[start : start + len(row)] = row
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


_loaded: dict[int, Bpe] = {}


def _tokenizer(text: str) -> Bpe:
    """The tokenizer of this worker, built once for all its tasks."""
    key = hash(text)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Bpe(text)
    return _loaded[key]


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text encoded and decoded again: doc_id, ids, n_tokens, decoded.

    ``tokenizer`` is the content of a tokenizers JSON file, a vocabulary of some 50,000 entries (1.5 MB), which each
    executor gets once. Documents are encoded where they are read: no shuffle, no state between rows. A missing text counts as
    empty and gives no ids. Special tokens written out in a text become their ids, as in the library. Repeated rows give repeated rows;
    other columns are left out. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def make():
        bpe = _tokenizer(shared.value)

        def run(texts: list) -> list:
            ids = [bpe.encode(t or "") for t in texts]
            return [_ids(ids), [len(x) for x in ids], [bpe.decode(x) for x in ids]]

        return run

    fields = [("ids", "array<int>", pa.list_(pa.int32())), ("n_tokens", "bigint", pa.int64()), ("decoded", "string", pa.string())]
    return map_texts(docs, id_col, text_col, make, fields, AT_ONCE)


def encode_rows(docs: DataFrame, tokenizer: str, text_col: str = "text", drop: tuple[str, ...] = ("text",)) -> DataFrame:
    """``docs`` without the columns in ``drop``, with ids, n_tokens, and round_trip (whether the ids decode to the text). Columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def make():
        bpe = _tokenizer(shared.value)

        def run(texts: list) -> list:
            ids = [bpe.encode(t or "") for t in texts]
            return [_ids(ids), [len(x) for x in ids], [bpe.decode(x) == (t or "") for x, t in zip(ids, texts)]]

        return run

    fields = [("ids", "array<int>", pa.list_(pa.int32())), ("n_tokens", "bigint", pa.int64()), ("round_trip", "boolean", pa.bool_())]
    return add_by_text(docs, text_col, make, fields, (*drop, *[name for name, _, _ in fields]), AT_ONCE)


def digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode_decode``, but with digests in place of ids and text: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def make():
        bpe = _tokenizer(shared.value)

        def run(texts: list) -> list:
            counts, of_ids, of_text = [], [], []
            for text in texts:
                ids = bpe.encode(text or "")
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            return [counts, of_ids, of_text]

        return run

    fields = [("n_tokens", "bigint", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
    return map_texts(docs, id_col, text_col, make, fields, AT_ONCE)
