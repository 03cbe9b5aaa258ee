"""Token ids of texts by way of their white-space chunks and words.

The vocabulary's rules drop white space and never look across it, so a text's ids are the
ids of its chunks in order, and a chunk's those of its words. Each worker keeps the ids of
a bounded number of chunks and words; only words it has not met are encoded, many at once.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import regex

from sightline.llm.common import ragged

# Python's split() takes these for white space, the vocabulary's rules do not.
ODD = "\x1c\x1d\x1e\x1f"
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")

# Characters that the vocabulary's rules (Unicode 16) take for neither letters nor
# numbers, while the pattern library at hand does.
LATER = (
    r"\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    r"\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    r"\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    r"\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    r"\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    r"\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe\U0001e6ff"
    r"\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)

# Capitals newer than Python's tables, with their small letters (Unicode 16 and 17).
LATER_CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LATER_CAPITALS |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
# The first bytes that they share in UTF-8: a quick look for texts without any.
NEW_CAPITAL = tuple(sorted({chr(c).encode()[:-1] for c in LATER_CAPITALS}))

# Combining marks that the vocabulary's rules (Unicode 9 there) take for base characters,
# so that they neither change places nor compose, and the vowel sign of a later composition.
LATER_MARKS = re.compile(
    "([\u07fd\u0898-\u089f\u08ca-\u08d3\u09fe\u0c3c\u0d3b\u0d3c\u0eba\u1715\u1abf-\u1ace\u1df6-\u1dfa\ua82c\U00010d24-\U00010d27"
    "\U00010eab\U00010eac\U00010efd-\U00010eff\U00010f46-\U00010f50\U00010f82-\U00010f85\U00011070\U0001133b\U0001145e\U00011839\U0001183a"
    "\U00011930\U0001193d\U0001193e\U00011943\U000119e0\U00011a34\U00011a47\U00011a99\U00011d42\U00011d44\U00011d45\U00011d97\U00011f41"
    "\U00011f42\U00016ff0\U00016ff1\U0001e08f\U0001e130-\U0001e136\U0001e2ae\U0001e2ec-\U0001e2ef\U0001e4ec-\U0001e4ef]+)"
)

HELD = 400_000
#: The number that stands for the end of a chunk; the first place of a pool of words is taken by it.
END = 0


def chunks_of(text: str) -> list[str]:
    if any(c in text for c in ODD):
        return [c for c in SPACE.split(text) if c]
    return text.split()


def checked_vocabulary(file: str) -> str:
    """The file's JSON, if its rules are those that let white space part the work."""
    with open(file, encoding="utf-8") as f:
        raw = f.read()
    found = json.loads(raw)
    steps = [n["type"] for n in found["normalizer"]["normalizers"]]
    split = found["pre_tokenizer"]["pretokenizers"][0]
    if steps != ["NFC", "Replace", "Lowercase"] or not split["invert"] or split["behavior"] != "Removed" or found["post_processor"] is not None:
        raise ValueError(f"{file}: another kind of vocabulary")
    found["truncation"] = found["padding"] = None
    return json.dumps(found)


class Rules:
    """How a vocabulary cuts a chunk into normalised words and special strings."""

    def __init__(self, raw: str):
        found = json.loads(raw)
        self.special = {t["content"]: t["id"] for t in found["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        pattern = found["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        for kind in ("L", "N"):
            pattern = pattern.replace(rf"[\p{{{kind}}}]", rf"[\p{{{kind}}}--[{LATER}]]")
        pattern = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{LATER}]]")
        self.words = regex.compile(pattern, regex.V1)
        self.words_and_ends = regex.compile(pattern + r"|\n", regex.V1)

    @staticmethod
    def normal(text: str) -> str:
        if text.isascii():
            return text.lower()
        if LATER_MARKS.search(text):
            composed = "".join(p if k % 2 else unicodedata.normalize("NFC", p) for k, p in enumerate(LATER_MARKS.split(text)))
        else:
            composed = unicodedata.normalize("NFC", text)
        low = composed.replace("Σ", "σ").lower()
        data = low.encode("utf-8", "surrogatepass")
        return low.translate(LATER_CAPITALS) if any(b in data for b in NEW_CAPITAL) else low

    def words_of(self, chunks: list[str]) -> list[str]:
        """Normalised words of all chunks, with a line end after each chunk's."""
        return self.words_and_ends.findall(self.normal("\n".join([*chunks, ""]))) if chunks else []

    def special_pieces(self, chunk: str) -> list[str] | None:
        """Words and special strings of a chunk that holds a special string, else None."""
        if self.cut is None or not self.cut.search(chunk):
            return None
        found: list[str] = []
        for part in self.cut.split(chunk):
            found.extend([part] if part in self.special else self.words.findall(self.normal(part)))
        return found


class _Pool(dict):
    """Text -> number; ids of numbered texts lie in one flat array."""

    def __init__(self):
        super().__init__()
        self.wipe()

    def wipe(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def __missing__(self, text: str) -> int:
        number = self[text] = len(self)
        self.fresh.append(text)
        return number

    def settle(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        """Take in the ids of the fresh texts, in their order."""
        at = len(self) - len(self.fresh)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while len(self) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.flat[self.used : self.used + len(flat)] = flat
        self.starts[at : len(self)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[at : len(self)] = lengths
        self.used += len(flat)
        self.fresh = []

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many texts in a row, and how many each has."""
        lengths = self.lengths[numbers]
        return self.flat[ragged(self.starts[numbers], lengths)], lengths


def _sums(lengths: np.ndarray, counts: list[int] | np.ndarray) -> np.ndarray:
    """Ends, from 0, of groups of counts[k] lengths each."""
    return np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]


class ChunkIds:
    """Ids of texts; ``encode`` gives (flat ids, lengths) of words it is handed."""

    def __init__(self, rules: Rules, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], held: int = HELD):
        self.rules, self.encode, self.held = rules, encode, held
        self.chunks, self.words = _Pool(), _Pool()
        self.words["\n"] = END

    def _settle(self) -> None:
        if not self.chunks.fresh:
            return
        # Chunks of letters alone are one word each; the others are cut by the rules together.
        letters, at_letters, mixed, at_mixed, special = [], [], [], [], {}
        for k, chunk in enumerate(self.chunks.fresh):
            if chunk.isalpha():
                letters.append(chunk)
                at_letters.append(k)
            elif "<|" in chunk and (found := self.rules.special_pieces(chunk)) is not None:
                special[k] = found
            else:
                mixed.append(chunk)
                at_mixed.append(k)
        low = self.rules.normal("\n".join(letters)).split("\n") if letters else []
        for chunk, k, word in zip(letters, at_letters, low, strict=True):
            if not word.isalpha():  # a letter became a letter and a mark
                special[k] = self.rules.words.findall(word)
        number = self.words.__getitem__
        counts = np.ones(len(self.chunks.fresh), np.int64)
        marked = np.fromiter(map(number, self.rules.words_of(mixed)), np.int64)
        ends = np.flatnonzero(marked == END)
        counts[at_mixed] = np.diff(np.append(-1, ends)) - 1
        for k, parts in special.items():
            counts[k] = len(parts)
        numbers = np.zeros(int(counts.sum()), np.int64)
        starts = np.cumsum(counts) - counts
        plain = np.array([k for k in at_letters if k not in special] if special else at_letters, np.int64)
        words = [w for w, k in zip(low, at_letters) if k not in special] if special else low
        numbers[starts[plain]] = np.fromiter(map(number, words), np.int64, len(words))
        numbers[ragged(starts[at_mixed], counts[at_mixed])] = marked[marked != END]
        for k, parts in special.items():
            numbers[starts[k] : starts[k] + len(parts)] = [number(w) for w in parts]
        if self.words.fresh:
            self.words.settle(*self.encode(self.words.fresh))
        flat, lengths = self.words.ids(numbers)
        self.chunks.settle(flat, np.diff(_sums(lengths, counts)))

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ends): the ids of text k are flat[ends[k] : ends[k + 1]]."""
        if len(self.chunks) > self.held:
            self.chunks.wipe()
        if len(self.words) > self.held:
            self.words.wipe()
            self.words["\n"] = END
        numbers, counts = [], []
        for text in texts:
            parts = chunks_of(text)
            counts.append(len(parts))
            numbers.append(np.fromiter(map(self.chunks.__getitem__, parts), np.int32, len(parts)))
        self._settle()
        flat, lengths = self.chunks.ids(np.concatenate(numbers) if numbers else np.empty(0, np.int32))
        return flat, _sums(lengths, counts)
