"""Byte-pair encoding and decoding with batched numpy merge rounds.

The symbols of many words lie in one flat array. Every round finds each word's pair of
lowest rank by binary search over the sorted pair keys, and merges it: all occurrences at once
where no rule of the new symbol has a lower rank than the pair's own, else the leftmost one.
Words that have no more pairs leave the array.

Defined cases: a null or empty text has no ids and decodes to the empty text; texts of any
length are encoded whole; special strings of the vocabulary inside a text become their ids;
repeated rows get equal ids; other columns are never read.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.chunks import ChunkIds, Rules, checked_vocabulary
from sightline.llm.common import batches, texts_of, worker_store


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else one from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, extra = [], 0
    for b in range(256):
        if b in plain:
            letters.append(chr(b))
        else:
            letters.append(chr(256 + extra))
            extra += 1
    return letters


class Merges:
    """The tables of one vocabulary."""

    def __init__(self, raw: str):
        found = json.loads(raw)
        model = found["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.rules = Rules(raw)
        self.special = self.rules.special
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        self.text = [""] * self.size
        for t, i in [*vocab.items(), *self.special.items()]:
            self.text[i] = t
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        new = np.array([vocab[a + b] for a, b in pairs], np.int64)
        rank = np.arange(len(pairs))
        lowest = np.full(self.size, len(pairs))
        np.minimum.at(lowest, left, rank)
        np.minimum.at(lowest, right, rank)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.new = keys[order], rank[order], new[order]
        self.whole = (lowest[new] > rank)[order]

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, lengths) of words that are not empty."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[raw[ends]]
        owner = np.repeat(np.arange(len(words)), lengths)
        ready: list[tuple[np.ndarray, np.ndarray]] = []
        none = len(self.keys)
        while len(symbols):
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.searchsorted(self.keys, key)
            at[at == none] = 0
            inside = (owner[:-1] == owner[1:]) & (self.keys[at] == key)
            rank = np.append(np.where(inside, self.rank[at], none), none)
            at = np.append(at, 0)
            start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(rank, start)
            sizes = np.diff(np.append(start, len(symbols)))
            done = least == none
            if done.any():
                over = np.repeat(done, sizes)
                ready.append((owner[over], symbols[over]))
                stay = ~over
                at, rank, symbols, owner = at[stay], rank[stay], symbols[stay], owner[stay]
                least, sizes = least[~done], sizes[~done]
                if not len(symbols):
                    break
            # Of overlapping occurrences, as in "aaa", every second one counts, from the left.
            spot = np.flatnonzero(rank == np.repeat(least, sizes))
            own = owner[spot]
            follows = np.append(False, (spot[1:] == spot[:-1] + 1) & (own[1:] == own[:-1]))
            head = np.maximum.accumulate(np.where(follows, 0, np.arange(len(spot))))
            keep = (np.arange(len(spot)) - head) % 2 == 0
            first = np.append(True, own[1:] != own[:-1])
            spot = spot[keep & (self.whole[at[spot]] | first)]
            symbols[spot] = self.new[at[spot]]
            rest = np.ones(len(symbols), bool)
            rest[spot + 1] = False
            symbols, owner = symbols[rest], owner[rest]
        if not ready:
            return np.empty(0, np.int64), lengths
        whose, ids = (np.concatenate(x) for x in zip(*ready, strict=True))
        order = np.argsort(whose, kind="stable")
        return ids[order], np.bincount(whose, minlength=len(words))

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, lengths) of normalised words and special strings, a bounded share at a time."""
        flat, lengths, group, held = [], [], [], 0
        for w in words:
            if w in self.special:
                if group:
                    self._add(flat, lengths, group)
                flat.append(np.array([self.special[w]]))
                lengths.append(np.array([1]))
                group, held = [], 0
                continue
            group.append(w.encode("utf-8", "surrogatepass"))
            held += len(group[-1])
            if held > 1_000_000:
                self._add(flat, lengths, group)
                group, held = [], 0
        if group:
            self._add(flat, lengths, group)
        return (np.concatenate(flat), np.concatenate(lengths)) if flat else (np.empty(0, np.int64), np.empty(0, np.int64))

    def _add(self, flat: list, lengths: list, group: list[bytes]) -> None:
        ids, sizes = self.merged(group)
        flat.append(ids)
        lengths.append(sizes)

    def decode(self, ids: np.ndarray) -> str:
        """Tokens with one space between them."""
        return " ".join(map(self.text.__getitem__, ids.tolist()))


#: Chunks and words whose ids a task keeps (about 180 bytes each).
TASK_HELD = 100_000


def merges_of(raw: str) -> tuple[Merges, ChunkIds]:
    """The tables of a vocabulary, made once per worker, and an empty store of chunks.

    The store ends with its task, so that workers hold no more than the tables in between.
    """
    held, key = worker_store(), hashlib.sha256(raw.encode()).hexdigest()
    if held.get("merges", ("",))[0] != key:
        held["merges"] = key, Merges(raw)
    made = held["merges"][1]
    return made, ChunkIds(made.rules, made.encode_words, TASK_HELD)


def bpe_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) of each row of ``docs``; ``vocabulary`` is the file's path on the driver."""
    raw = docs.sparkSession.sparkContext.broadcast(checked_vocabulary(vocabulary))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def begin():
        _, chunks = merges_of(raw.value)
        return lambda batch: rows(batch, chunks)

    def rows(batch: pa.RecordBatch, chunks: ChunkIds) -> dict:
        flat, ends = chunks.ids(texts_of(batch.column(1)))
        return {"doc_id": batch.column(0), "n_tokens": np.diff(ends), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))}

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(batches(schema, begin, 256, True), "doc_id long, n_tokens long, ids array<int>")


def bpe_texts(tokens: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) decoded from a column of ids; a null list is the empty text."""
    raw = tokens.sparkSession.sparkContext.broadcast(checked_vocabulary(vocabulary))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def begin():
        merges, _ = merges_of(raw.value)
        return lambda batch: rows(batch, merges)

    def rows(batch: pa.RecordBatch, merges: Merges) -> dict:
        return {"doc_id": batch.column(0), "text": [merges.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]}

    picked = tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return picked.mapInArrow(batches(schema, begin, 256, True), "doc_id long, text string")


def bpe_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of ``docs``.

    As bpe_tokens() and bpe_texts(), but only the digests of ids and decoded texts leave the worker.
    """
    raw = docs.sparkSession.sparkContext.broadcast(checked_vocabulary(vocabulary))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def begin():
        merges, chunks = merges_of(raw.value)
        return lambda batch: rows(batch, merges, chunks)

    def rows(batch: pa.RecordBatch, merges: Merges, chunks: ChunkIds) -> dict:
        flat, ends = chunks.ids(texts_of(batch.column(1)))
        flat = flat.astype("<u4")
        parts = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return {
            "doc_id": batch.column(0), "n_tokens": np.diff(ends), "ids_sha256": [hashlib.sha256(p).hexdigest() for p in parts],
            "decoded_sha256": [hashlib.sha256(merges.decode(p).encode("utf-8", "surrogatepass")).hexdigest() for p in parts],
        }

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(batches(schema, begin, 256, True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
