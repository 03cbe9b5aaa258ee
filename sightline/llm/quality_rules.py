"""Quality rules, line first: each line is judged by itself, failing lines go, and a
document that loses too much of its text goes as a whole.

A line without a word never fails. A phrase of page furniture fails a line only where the
phrases cover enough of its words, so a paragraph that mentions one stays. Furniture in words
that no list names is told by a line's build: a few words, half of them or more with a capital,
that neither end a sentence nor go on with the line before (menus, buttons, links); short
headings in capitals are built alike and go too. Scripts without capitals have no such lines.
Defined cases: a null text is an empty text; an empty
text has no words and fails the base rule; rows are judged one by one, so repeated rows
get equal verdicts; columns other than the two named ones are neither read nor harmed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sightline.llm.common import batches, texts_of

# Symbols counted by the base rule, white space that parts words.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"

# Phrases that mark a line as page furniture, in lower case.
BOILERPLATE = (
    "accept all cookies", "all rights reserved", "back to top", "click here", "cookie policy", "enable javascript",
    "lorem ipsum", "privacy policy", "sign up for our newsletter", "skip to content", "subscribe to our", "terms of use",
)

# The words of the usual filler paragraph; they count as covered where its first two stand.
FILLER = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad "
    "minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate "
    "velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim "
    "id est laborum".split()
)

SEPARATORS = {"|", "»", "›", ">", "<", "/", "·", "•", "::", "->", "→"}
SHOUT = re.compile(r"[!?]{2,}$")
LOUD = re.compile(r"[!?]{3,}$")
# A mark of rights next to a year, in either order.
RIGHTS = re.compile(r"(?i)(?:©|\(c\)|\bcopyright\b)[\s©(c),-]{0,8}(?:19|20)\d\d|(?:19|20)\d\d\s{0,2}(?:©|\(c\)|\bcopyright\b)")


@dataclass(frozen=True)
class QualityRules:
    """Thresholds; shares are of a line's words, ``max_lost`` of a document's word characters."""

    min_words: int = 10
    max_repeat_percent: int = 20
    repeat_window: int = 5
    symbol_word: float = 0.3
    separator: float = 0.2
    shout: float = 0.5
    boilerplate: float = 0.15
    loud: float = 0.4
    fragment_words: int = 10
    capitals: float = 0.5
    rights_words: int = 15
    max_lost: float = 0.3


def repeated_words(words: list[bytes], window: int) -> int:
    """Words inside windows of words that occur twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    # A window gets a number from the number of its first words and the next word: exact, no hash.
    key = codes[:n]
    for k in range(1, window):
        key = np.unique(key * len(ids) + codes[k : k + n], return_inverse=True)[1]
    again = np.bincount(key)[key] > 1
    if not again.any():
        return 0
    step = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(step, at, 1)
    np.add.at(step, at + window, -1)
    return int((np.cumsum(step)[:-1] > 0).sum())


def is_fragment(words: list[str], before: list[str] | None, rules: QualityRules) -> bool:
    """Whether a line is a few words, many with a capital, that end no sentence and continue none.

    ``before`` are the words of the line with words before it. A line goes on with it where that one
    is longer than a fragment and ends no sentence, as in text broken at a fixed width.
    """
    if len(words) > rules.fragment_words or not words[-1][-1].isalnum() or any(w[-1] in ".!?" and len(w) > 3 for w in words[:-1]):
        return False
    if before is not None and len(before) >= rules.fragment_words and (before[-1][-1].isalnum() or before[-1][-1] in ",;-"):
        return False
    cased = [w for w in (w.lstrip("\"'([{«“„‘¿¡") for w in words) if w and (w[0].isupper() or w[0].islower() or w[0].istitle())]
    return bool(cased) and sum(1 for w in cased if not w[0].islower()) >= rules.capitals * len(cased)


def line_fault(line: str, rules: QualityRules, before: list[str] | None = None) -> str | None:
    """The first rule that a line breaks, or None; ``before`` are the words of the line before it."""
    words = line.split()
    n = len(words)
    if not n:
        return None
    if any(c in line for c in SYMBOLS):
        bad = sum(1 for w in words if sum(w.count(c) for c in SYMBOLS) >= 2)
        if n >= 2 and bad > rules.symbol_word * n:
            return "punctuation"
    if n >= 3 and sum(1 for w in words if w in SEPARATORS) > rules.separator * n:
        return "navigation"
    if n >= 3 and ("!!" in line or "??" in line or "!?" in line):
        if sum(1 for w in words if SHOUT.search(w)) > rules.shout * n:
            return "punctuation"
        if sum(1 for w in words if LOUD.search(w)) >= rules.loud * n:
            return "punctuation"
    if n <= rules.rights_words and RIGHTS.search(line):
        return "boilerplate"
    if is_fragment(words, before, rules):
        return "fragment"
    low = line.lower()
    found = [p for p in BOILERPLATE if p in low]
    if found:
        covered = sum(low.count(p) * len(p.split()) for p in found if p != "lorem ipsum")
        if "lorem ipsum" in found:
            covered += sum(1 for w in low.split() if w.strip(".,;:!?\"'()") in FILLER)
        if covered > rules.boilerplate * n:
            return "boilerplate"
    return None


def word_chars(text: str) -> int:
    return len(text) - sum(text.count(c) for c in SPACES)


def judge(text: str, rules: QualityRules) -> dict:
    """Counts, verdict and cleaned text of one document."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = text.split("\n")
    seen: set[str] = set()
    again = lost = failed = 0
    kept_lines = []
    before = None
    for line in lines:
        if not line.strip(SPACES):
            kept_lines.append(line)
            continue
        if line in seen:
            again += 1
        else:
            seen.add(line)
        fault = line_fault(line, rules, before)
        before = line.split() or None
        if fault is None:
            kept_lines.append(line)
        else:
            failed += 1
            lost += word_chars(line)
    chars = word_chars(text)
    repeat = repeated_words(words, rules.repeat_window)
    base = len(words) < rules.min_words or 100 * repeat > rules.max_repeat_percent * len(words)
    return {
        "n_words": len(words), "word_chars": chars, "n_symbols": sum(text.count(c) for c in SYMBOLS), "n_dup_lines": again,
        "n_repeat_words": repeat, "n_failed_lines": failed, "lost_chars": lost, "base_failed": base,
        "kept": not base and lost <= rules.max_lost * chars, "clean": text if not failed else "\n".join(kept_lines),
    }


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_failed_lines", "lost_chars")


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: QualityRules | None = None) -> DataFrame:
    """One row per row of ``docs``: counts, base verdict, verdict. Nothing is shuffled."""
    rules = rules or QualityRules()
    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    schema = pa.schema(
        [("doc_id", pa.int64()), *((m, pa.int64()) for m in MEASURES), ("base_failed", pa.bool_()), ("kept", pa.bool_())]
    )

    def rows(batch: pa.RecordBatch) -> dict:
        found = [judge(t, rules) for t in texts_of(batch.column(1))]
        return {"doc_id": batch.column(0), **{f.name: [x[f.name] for x in found] for f in list(schema)[1:]}}

    spark_schema = ", ".join(["doc_id long", *(f"{m} long" for m in MEASURES), "base_failed boolean", "kept boolean"])
    return picked.mapInArrow(batches(schema, rows), spark_schema)


def quality_filter(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", rules: QualityRules | None = None) -> DataFrame:
    """``docs`` without rejected documents and, in the rest, without failing lines.

    All columns stay; ``length_col``, where there is one, follows a changed text.
    """
    rules = rules or QualityRules()

    def run(stream):
        for batch in (whole.slice(k, 512) for whole in stream for k in range(0, len(whole), 512)):
            at = batch.schema.get_field_index(text_col)
            found = [judge(t, rules) for t in texts_of(batch.column(at))]
            keep = pa.array([x["kept"] for x in found], pa.bool_())
            columns = list(batch.columns)
            columns[at] = pa.array([x["clean"] for x in found], batch.schema.field(at).type)
            if length_col in batch.schema.names:
                k = batch.schema.get_field_index(length_col)
                old = batch.column(k).to_pylist()
                columns[k] = pa.array(
                    [len(x["clean"]) if x["n_failed_lines"] else v for x, v in zip(found, old, strict=True)], batch.schema.field(k).type
                )
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(keep)

    return docs.mapInArrow(run, docs.schema)
