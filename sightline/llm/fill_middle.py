"""Fill-in-the-middle documents, cut where chunk counts say.

A text's units are its words with the white space before them; white space at the end is
one more unit. Where a unit ends is found without reading a text unit by unit:

1. A rolling hash over the last 32 bytes cuts the text into chunks, so equal passages of
   different documents give equal chunks wherever they stand.
2. A chunk's boundary summary (code points, words, whether its first and last byte are part of
   a word) is computed once and kept under the chunk's bytes. A chunk counts as known only if
   its bytes are equal, not just its hash.
3. Summaries combine: a word that goes over a chunk border is counted once, where it ends.
   Running sums over a document's chunks give its number of units, and show in which chunk a
   wanted unit ends; only that chunk is looked into.

Defined cases: a null text is the empty text; a null id is hashed as the empty text; an empty
text and one that holds a mark of the template are plain and stay as they are; repeated rows
give equal rows; other columns, whatever their names, stay beside the new ones only in
``fill_in_middle`` and are never read. A chunk has at most ``longest`` bytes, so a text without
cut points costs no more than others; a task holds one slice of rows and a bounded cache.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import batches, utf8

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
WINDOW = 32
SLICE = 1 << 20


@dataclass(frozen=True)
class MiddleSpec:
    """Template marks and rates (percent), chunk size (a cut about every ``2**cut_bits`` bytes) and
    how many bytes of chunks a task keeps."""

    seed: int = 42
    prefix_mark: str = "<P>"
    suffix_mark: str = "<S>"
    middle_mark: str = "<M>"
    rate: int = 50
    spm_rate: int = 80
    cut_bits: int = 7
    longest: int = 2048
    kept_bytes: int = 16 << 20

    @property
    def marks(self) -> tuple[bytes, bytes, bytes]:
        return self.prefix_mark.encode(), self.suffix_mark.encode(), self.middle_mark.encode()

    def __post_init__(self):
        if any(not m or m in o for k, m in enumerate(self.marks) for o in self.marks[:k] + self.marks[k + 1 :]):
            raise ValueError("marks must be set and none may lie in another")


GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """Gear hash of the 32 bytes up to each byte: sum of table[byte] << distance, by doubling."""
    state = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        state[step:] += state[:-step] << np.uint32(step)
    return state


def chunk_starts(data: np.ndarray, spec: MiddleSpec) -> np.ndarray:
    """Where chunks of a UTF-8 text start: after each cut point, and inside gaps that are too long."""
    found = [np.zeros(1, np.int64)]
    for at in range(0, len(data), SLICE):
        low = max(at - WINDOW, 0)
        state = rolling(data[low : at + SLICE])
        cut = np.flatnonzero(state >> np.uint32(32 - spec.cut_bits) == 0) + low + 1
        found.append(cut[(cut > max(at, WINDOW)) & (cut <= at + SLICE)])
    starts = np.concatenate(found)
    starts = starts[starts < len(data)]
    gaps = np.diff(np.append(starts, len(data)))
    if len(gaps) and gaps.max() > spec.longest:
        more = [np.arange(s, s + g, spec.longest) for s, g in zip(starts[gaps > spec.longest], gaps[gaps > spec.longest])]
        starts = np.unique(np.concatenate([starts, *more]))
    for _ in range(3):  # a chunk begins with a whole character
        inside = data[starts] & 0xC0 == 0x80
        if not inside.any():
            break
        starts = starts + inside
        starts = starts[starts < len(data)]
    return np.unique(starts)


class Summaries:
    """Boundary summaries by content."""

    def __init__(self, limit: int):
        self.known: dict[bytes, tuple] = {}
        self.limit, self.held = limit, 0

    def __call__(self, chunk: bytes) -> tuple:
        got = self.known.get(chunk)
        if got is None:
            if self.held > self.limit:
                self.known.clear()
                self.held = 0
            # bytes.split() parts at exactly the six white-space characters of the unit pattern.
            got = self.known[chunk] = (len(chunk.decode()), len(chunk.split()), chunk[0] not in b" \t\n\r\x0b\x0c", chunk[-1] not in b" \t\n\r\x0b\x0c")
            self.held += len(chunk) + 150
        return got


@dataclass
class Document:
    """Combined summaries of one text."""

    text: bytes
    starts: np.ndarray
    chars: np.ndarray
    ends: np.ndarray
    early: np.ndarray
    units: int
    words: int

    def cut(self, k: int) -> tuple[int, int]:
        """(bytes, code points) before the end of unit ``k``."""
        if k <= 0:
            return 0, 0
        if k >= self.units or k > self.ends[-1]:
            return len(self.text), int(self.chars[-1])
        c = int(np.searchsorted(self.ends, k))
        inside = k - (int(self.ends[c - 1]) if c else 0) - int(self.early[c])
        begin = int(self.starts[c])
        before = int(self.chars[c - 1]) if c else 0
        if inside == 0:  # the word of the chunk before ends at the border
            return begin, before
        stop = int(self.starts[c + 1]) if c + 1 < len(self.starts) else len(self.text)
        chunk = self.text[begin:stop]
        for n, word in enumerate(WORD.finditer(chunk), 1):
            if n == inside:
                return begin + word.end(), before + len(chunk[: word.end()].decode())
        raise AssertionError("a summary does not fit its chunk")


def combined(text: bytes, summaries: Summaries, spec: MiddleSpec) -> Document:
    starts = chunk_starts(np.frombuffer(text, np.uint8), spec) if text else np.zeros(0, np.int64)
    if not len(starts):
        return Document(text, starts, starts, starts, starts, 0, 0)
    borders = [*starts.tolist(), len(text)]
    rows = [summaries(text[a:b]) for a, b in zip(borders, borders[1:])]
    chars, words, head, tail = (np.array(c, np.int64) for c in zip(*rows))
    early = np.zeros(len(rows), np.int64)
    early[1:] = tail[:-1] & (1 - head[1:])
    # A word ends in the chunk that holds the white space after it; the last one with the text.
    ends = np.cumsum(words - tail + early)
    n_words = int(ends[-1] + tail[-1])
    return Document(text, starts, np.cumsum(chars), ends, early, n_words + int(not tail[-1]), n_words)


def transformed(doc_id, text: bytes, summaries: Summaries, spec: MiddleSpec) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one document."""
    doc = combined(text, summaries, spec)
    digest = hashlib.sha256(f"{spec.seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    h = [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]
    p, s, m = spec.marks
    if not text or h[2] % 100 >= spec.rate or p in text or s in text or m in text:
        return doc.units, "plain", None, None, text
    low, high = sorted((h[0] % (doc.units + 1), h[1] % (doc.units + 1)))
    (a, a_chars), (b, b_chars) = doc.cut(low), doc.cut(high)
    head, middle, rest = text[:a], text[a:b], text[b:]
    spm = h[3] % 100 < spec.spm_rate
    out = s + rest + p + head + m + middle if spm else p + head + s + rest + m + middle
    return doc.units, "spm" if spm else "psm", a_chars, b_chars - a_chars, out


MIDDLE = "n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spec: MiddleSpec | None = None) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), one row per row of ``docs``.

    ``n`` counts units; the character counts are null where the form is plain.
    """
    spec = spec or MiddleSpec()
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]
    )

    def start():
        summaries = Summaries(spec.kept_bytes)

        def rows(batch: pa.RecordBatch) -> dict:
            ids = batch.column(0).to_pylist()
            made = [transformed(i, t, summaries, spec) for i, t in zip(ids, utf8(batch.column(1)), strict=True)]
            n, form, before, middle, out = zip(*made) if made else ([],) * 5
            return {"doc_id": ids, "n": n, "form": form, "prefix_chars": before, "middle_chars": middle, "output": pa.array(out, pa.binary()).cast(pa.string())}

        return rows

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(batches(schema, start, step=128, per_task=True), f"doc_id long, {MIDDLE}")


def restored(output: Column, form: Column, spec: MiddleSpec | None = None) -> Column:
    """The text that a transformed document was made from, read from its marks alone."""
    spec = spec or MiddleSpec()

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        a, b, m = len(first), len(second), len(spec.middle_mark)
        cut = F.locate(second, output)
        rest = F.substring(output, cut + b, F.length(output))
        cut_rest = F.locate(spec.middle_mark, rest)
        return F.substring(output, F.lit(a + 1), cut - 1 - a), F.substring(rest, F.lit(1), cut_rest - 1), F.substring(rest, cut_rest + m, F.length(rest))

    head, tail, middle = parts(spec.prefix_mark, spec.suffix_mark)
    s_tail, s_head, s_middle = parts(spec.suffix_mark, spec.prefix_mark)
    return F.when(form == "psm", F.concat(head, middle, tail)).when(form == "spm", F.concat(s_head, s_middle, s_tail)).otherwise(output)
