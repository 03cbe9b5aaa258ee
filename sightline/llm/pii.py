"""Personal data: fixed patterns, and a character-level tagger beside them.

The tagger is a bidirectional LSTM with CRF transitions in numpy, trained from labelled
spans of the four kinds: those that the patterns find, and the same values in other writings
that the patterns miss (``written_otherwise``). It reads overlapping windows around every place of
a text that has a digit, an at sign or a bracketed "at"; each window is decoded by Viterbi, and where
windows overlap each character takes its tag from the window in whose middle it lies deepest. Spans
of the patterns always stay; the tagger adds spans that touch none of them and whose value
is valid for their kind (``plausible``).

Defined cases: a null or empty text has no spans; repeated rows get equal spans; texts of any
length are read whole: windows are cut and decoded some thousand at a time, and a few bytes are kept
for each character; other columns are never read. Characters without any trigger within reach
cannot carry personal data of these kinds and are not tagged.
"""

from __future__ import annotations

import re
import zlib
from array import array
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import batches, texts_of

KINDS = ("email", "ip", "card", "phone")

# The base patterns.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

NUMBERS = re.compile(r"[0-9][0-9. -]*")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns by start, then kind: leftmost, not overlapping within a kind."""
    found = []
    at, free = text.find("@"), 0
    while at >= 0:
        # Any match over this @ starts in the run of local characters before it.
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        tail = DOMAIN.match(text, at + 1) if start < at else None
        if tail:
            found.append((start, 0, tail.end()))
            free = tail.end()
        at = text.find("@", max(at + 1, free))
    for run in NUMBERS.finditer(text):
        a, b = run.span()
        if b - a < 2:
            continue
        if text.find(".", a, b) >= 0:
            for m in IP.finditer(text, a, b):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                    found.append((m.start(), 1, m.end()))
        if b - a >= 14:
            for m in CARD.finditer(text, a, b):
                digits = _digits(m.group())
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    found.sort()
    return [(KINDS[k], a, b) for a, k, b in found]


# ---- the tagger ----

LETTERS = "abcdefghijklmnopqrstuvwxyz"
MARKS = "0@.+-_()% :/\n[]{}"
N_CHARS = 1 + len(LETTERS) + len(MARKS) + 3  # other, letters, marks, upper case, other letters, other spaces
N_TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
TRIGGER = re.compile(r"[0-9@]|[\[({] ?at ?[\])}]")


def char_codes(text: str) -> np.ndarray:
    """Small codes of characters, a byte each: one for all digits, one for all capitals."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _TABLE[np.minimum(points, len(_TABLE) - 1)]


def _table() -> np.ndarray:
    table = np.zeros(129, np.uint8)
    for k, c in enumerate(LETTERS):
        table[ord(c)] = 1 + k
        table[ord(c.upper())] = N_CHARS - 3
    for k, c in enumerate(MARKS):
        table[ord(c)] = 1 + len(LETTERS) + k
    table[ord("0") : ord("9") + 1] = table[ord("0")]
    for c in "\t\r\v\f":
        table[ord(c)] = N_CHARS - 1
    table[128] = N_CHARS - 2  # all code points from here on
    return table


_TABLE = _table()


@dataclass(frozen=True)
class TaggerSpec:
    """Window length and reach around a trigger, sizes of the net, and the bounded training: at most
    ``sample`` documents, ``spans`` spans of each in ``variants`` other writings, ``windows`` windows
    of each with a span and as many without, and ``steps`` batches."""

    window: int = 64
    stride: int = 32
    embed: int = 8
    hidden: int = 16
    steps: int = 300
    batch: int = 48
    rate: float = 0.025
    sample: int = 2000
    spans: int = 8
    variants: int = 4
    windows: int = 64
    seed: int = 7


@dataclass
class Tagger:
    spec: TaggerSpec
    w: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self) -> Tagger:
        rng = np.random.default_rng(self.spec.seed)
        e, h = self.spec.embed, self.spec.hidden
        self.w = {"emb": rng.normal(0, 0.3, (N_CHARS, e)), "out": rng.normal(0, 0.3, (2 * h, N_TAGS)), "bias": np.zeros(N_TAGS), "move": np.zeros((N_TAGS, N_TAGS))}
        for side in "fb":
            self.w["in" + side] = rng.normal(0, 0.3, (e, 4 * h))
            self.w["re" + side] = rng.normal(0, 0.3, (h, 4 * h))
            self.w["bi" + side] = np.repeat([0.0, 1.0, 0.0, 0.0], h)
        return self

    def _lstm(self, side: str, x: np.ndarray, keep: list | None) -> np.ndarray:
        n, t, _ = x.shape
        h = self.spec.hidden
        pre = x @ self.w["in" + side] + self.w["bi" + side]
        out = np.empty((n, t, h), x.dtype)
        s, c = np.zeros((n, h), x.dtype), np.zeros((n, h), x.dtype)
        for k in range(t) if side == "f" else range(t - 1, -1, -1):
            z = pre[:, k] + s @ self.w["re" + side]
            g = 1 / (1 + np.exp(-z[:, : 3 * h]))
            i, f, o = g[:, :h], g[:, h : 2 * h], g[:, 2 * h :]
            u = np.tanh(z[:, 3 * h :])
            old_c, old_s = c, s
            c = f * c + i * u
            tc = np.tanh(c)
            s = o * tc
            out[:, k] = s
            if keep is not None:
                keep.append((k, i, f, o, u, tc, old_c, old_s))
        return out

    def scores(self, codes: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Tag scores of each character, windows x length x tags."""
        x = self.w["emb"][codes]
        f, b = ([], []) if keep is not None else (None, None)
        h = np.concatenate([self._lstm("f", x, f), self._lstm("b", x, b)], axis=2)
        if keep is not None:
            keep.update(x=x, h=h, f=f, b=b)
        return h @ self.w["out"] + self.w["bias"]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Best tag path of each window (Viterbi)."""
        e = self.scores(codes)
        n, t, _ = e.shape
        best, back = e[:, 0], np.empty((n, t, N_TAGS), np.int64)
        for k in range(1, t):
            total = best[:, :, None] + self.w["move"][None]
            back[:, k] = total.argmax(1)
            best = total.max(1) + e[:, k]
        path = np.empty((n, t), np.int64)
        path[:, -1] = best.argmax(1)
        for k in range(t - 1, 0, -1):
            path[:, k - 1] = back[np.arange(n), k, path[:, k]]
        return path

    def gradients(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tag paths, and its gradients."""
        keep: dict = {}
        e = self.scores(codes, keep)
        n, t, _ = e.shape
        move = self.w["move"]
        ahead, behind = np.empty_like(e), np.zeros_like(e)
        ahead[:, 0] = e[:, 0]
        for k in range(1, t):
            v = ahead[:, k - 1][:, :, None] + move
            m = v.max(1)
            ahead[:, k] = m + np.log(np.exp(v - m[:, None]).sum(1)) + e[:, k]
        for k in range(t - 2, -1, -1):
            v = move[None] + (e[:, k + 1] + behind[:, k + 1])[:, None, :]
            m = v.max(2)
            behind[:, k] = m + np.log(np.exp(v - m[:, :, None]).sum(2))
        m = ahead[:, -1].max(1)
        norm = m + np.log(np.exp(ahead[:, -1] - m[:, None]).sum(1))
        rows = np.arange(n)[:, None]
        gold = e[rows, np.arange(t)[None], tags].sum(1) + move[tags[:, :-1], tags[:, 1:]].sum(1)
        de = np.exp(ahead + behind - norm[:, None, None])
        np.subtract.at(de, (rows, np.arange(t)[None], tags), 1.0)
        dmove = np.zeros_like(move)
        for k in range(1, t):
            v = ahead[:, k - 1][:, :, None] + move[None] + (e[:, k] + behind[:, k])[:, None, :] - norm[:, None, None]
            dmove += np.exp(v).sum(0)
        np.subtract.at(dmove, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1.0)
        de /= n
        g = {"move": dmove / n, "out": np.einsum("nth,ntk->hk", keep["h"], de), "bias": de.sum((0, 1))}
        dh = de @ self.w["out"].T
        hid = self.spec.hidden
        dx = np.zeros_like(keep["x"])
        for side, part in (("f", dh[:, :, :hid]), ("b", dh[:, :, hid:])):
            wre = self.w["re" + side]
            dpre = np.empty((n, t, 4 * hid))
            ds, dc = np.zeros((n, hid)), np.zeros((n, hid))
            dre = np.zeros_like(wre)
            for k, i, f, o, u, tc, old_c, old_s in reversed(keep[side]):
                ds = ds + part[:, k]
                dc = dc + ds * o * (1 - tc * tc)
                dz = np.concatenate([dc * u * i * (1 - i), dc * old_c * f * (1 - f), ds * tc * o * (1 - o), dc * i * (1 - u * u)], axis=1)
                dpre[:, k] = dz
                dre += old_s.T @ dz
                ds, dc = dz @ wre.T, dc * f
            g["re" + side], g["bi" + side] = dre, dpre.sum((0, 1))
            g["in" + side] = np.einsum("nte,ntk->ek", keep["x"], dpre)
            dx += dpre @ self.w["in" + side].T
        demb = np.zeros_like(self.w["emb"])
        np.add.at(demb, codes, dx)
        g["emb"] = demb
        return float((norm - gold).mean()), g

    def train(self, codes: np.ndarray, tags: np.ndarray) -> list[float]:
        """Adam over random batches; returns the losses."""
        rng = np.random.default_rng(self.spec.seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        losses = []
        for step in range(1, self.spec.steps + 1):
            pick = rng.integers(0, len(codes), self.spec.batch)
            loss, grads = self.gradients(codes[pick].astype(np.int64), tags[pick].astype(np.int64))
            losses.append(loss)
            rate = self.spec.rate * min(1.0, 4 * (1 - step / (self.spec.steps + 1)))
            for k, g in grads.items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.w[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return losses


def span_tags(length: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    for kind, a, b in spans:
        k = KINDS.index(kind)
        tags[a:b] = 2 + 2 * k
        tags[a] = 1 + 2 * k
    return tags


def window_starts(text: str, spec: TaggerSpec) -> np.ndarray:
    """Starts of the overlapping windows that cover every trigger with half a window to spare.

    Starts are multiples of the stride, so neighbouring triggers share windows.
    """
    starts = array("q")
    for m in TRIGGER.finditer(text):
        low = max(0, (m.start() - spec.window + spec.stride // 2) // spec.stride * spec.stride)
        if starts and starts[-1] >= m.start() // spec.stride * spec.stride:
            continue
        for s in range(max(low, starts[-1] + spec.stride if starts else 0), m.start() // spec.stride * spec.stride + 1, spec.stride):
            starts.append(s)
    return np.frombuffer(starts, np.int64)


def windows(text: str, starts: np.ndarray, spec: TaggerSpec) -> np.ndarray:
    """Codes of the windows at ascending ``starts``; only the text from the first to the last is read."""
    low, high = int(starts[0]), int(starts[-1]) + spec.window
    codes = np.zeros(high - low, np.uint8)
    read = char_codes(text[low:high])
    codes[: len(read)] = read
    return codes[np.asarray(starts, np.int64)[:, None] - low + np.arange(spec.window)[None]]


def reconciled(length: int, starts: np.ndarray, paths: np.ndarray, spec: TaggerSpec) -> list[tuple[str, int, int]]:
    """Spans from the tags of all windows: each character takes the tag of its deepest window.

    Of equally deep windows the earlier one counts. 'Outside' is a tag like the others, so the
    spans of a passage depend on the windows over it alone.
    """
    marks = paths.any(1)
    if not marks.any():
        return []
    # Only windows that overlap one with a mark can settle anything.
    at = np.asarray(starts, np.int64)
    marked = at[marks]
    k = np.searchsorted(marked, at)
    near = (marked[np.minimum(k, len(marked) - 1)] - at < spec.window) & (k < len(marked)) | (k > 0) & (at - marked[np.maximum(k, 1) - 1] < spec.window)
    depth = np.minimum(np.arange(spec.window), np.arange(spec.window)[::-1]).astype(np.int8)  # windows have up to 256 characters
    deepest, tags = np.full(length, -1, np.int8), np.zeros(length, np.int8)
    for w in np.flatnonzero(near):
        over = slice(int(at[w]), min(int(at[w]) + spec.window, length))
        n = over.stop - over.start
        better = depth[:n] > deepest[over]
        deepest[over][better] = depth[:n][better]
        tags[over][better] = paths[w, :n][better]
    spans, kind, begun, last = [], None, 0, -2
    for p in np.flatnonzero(tags).tolist():
        tag = int(tags[p])
        here = KINDS[(tag - 1) // 2]
        if kind is not None and (here != kind or p != last + 1 or tag % 2 == 1):
            spans.append((kind, begun, last + 1))
            kind = None
        if kind is None:
            kind, begun = here, p
        last = p
    if kind is not None:
        spans.append((kind, begun, last + 1))
    return spans


#: Rows taken at a time, which bounds what is held besides the batch.
STEP = 512

# What an added span has to look like: all of it, whatever its separators.
FORMS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+ ?(@|[\[({] ?at ?[\])}]) ?[A-Za-z0-9-]+( ?(\.|[\[({] ?dot ?[\])}]) ?[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|\.) ?[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9](?:[ ./_-]{0,2}[0-9])+"),
    "phone": re.compile(r"\+?\(?[0-9](?:[ ().\/-]{0,2}[0-9])+"),
}


def plausible(text: str, kind: str, a: int, b: int) -> list[tuple[str, int, int]]:
    """The spans of valid values in a tagged span: itself without outer white space or, where several numbers
    in a row were tagged as one card, those of them that are cards. An ip has four parts of at most
    255; a card 14 to 19 digits that pass the checksum; a phone 10 to 15, with a plus or separators."""
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    piece = text[a:b]
    if not FORMS[kind].fullmatch(piece) or a > 0 and text[a - 1].isalnum() or b < len(text) and text[b].isalnum():
        return []
    digits = _digits(piece)
    if kind == "ip":
        good = all(int(p) <= 255 for p in re.findall("[0-9]+", piece))
    elif kind == "card":
        good = 14 <= len(digits) <= 19 and luhn(digits)
        if not good and len(digits) > 19:
            numbers = [(kind, a + m.start(), a + m.end()) for m in re.finditer("[0-9]+", piece)]
            return [n for n in numbers if 14 <= n[2] - n[1] <= 19 and luhn(text[n[1] : n[2]])]
    elif kind == "phone":
        good = 10 <= len(digits) <= 15 and len(piece) > len(digits)
    else:
        good = True
    return [(kind, a, b)] if good else []


def tagged_spans(texts: list[str], tagger: Tagger, rows: int = 1024) -> list[list[tuple[str, int, int]]]:
    """The tagger's spans of each text; windows of many texts are decoded together, ``rows`` at a time."""
    starts = [window_starts(t, tagger.spec) for t in texts]
    paths: list[list[np.ndarray]] = [[] for _ in texts]
    held: list[tuple[int, np.ndarray]] = []

    def decode() -> None:
        if held:
            found = tagger.decode(np.concatenate([w for _, w in held])).astype(np.int8)
            for (k, w), path in zip(held, np.split(found, np.cumsum([len(w) for _, w in held])[:-1]), strict=True):
                paths[k].append(path)
            held.clear()

    size = 0
    for k, (text, at) in enumerate(zip(texts, starts, strict=True)):
        for lo in range(0, len(at), rows):
            held.append((k, windows(text, at[lo : lo + rows], tagger.spec)))
            size += len(held[-1][1])
            if size >= rows:
                decode()
                size = 0
    decode()
    found = []
    for text, at, path in zip(texts, starts, paths, strict=True):
        spans = reconciled(len(text), at, np.concatenate(path), tagger.spec) if len(at) else []
        found.append([x for s in spans for x in plausible(text, *s)])
    return found


#: Characters of a text on each side of a span that is written otherwise.
AROUND = 80


def written_otherwise(kind: str, value: str, rng: np.random.Generator) -> tuple[str, int, int] | None:
    """A writing of a real value that the patterns miss, and where in it the value stands.

    Email: a bracketed at, with the dots as they are or in brackets, or spaces around the at sign. Ip: dots in
    brackets or between spaces. Card: groups of four set off by dots, slashes or two spaces, or the
    number right behind another one. Phone: no plus, with dots, spaces, slashes or brackets.
    """
    digits = _digits(value)
    if kind == "email":
        name, _, host = value.partition("@")
        at = ["[at]", " [at] ", "(at)", " (at) ", " @ ", " {at} "][rng.integers(6)]
        dot = ["[dot]", " [dot] ", "(dot)", " (dot) ", "."][rng.integers(5)]
        form = name + at + host.replace(".", dot if at != " @ " else ".")
    elif kind == "ip":
        form = value.replace(".", ["[.]", " . ", "(.)"][rng.integers(3)])
    elif kind == "card":
        how = rng.integers(4)
        if how == 3:
            other = "".join(map(str, rng.integers(0, 10, 16)))
            return f"{other} {digits}", 17, 17 + len(digits)
        form = [".", "/", "  "][how].join(digits[k : k + 4] for k in range(0, len(digits), 4))
    else:
        if len(digits) < 10:
            return None
        head, a, b, c = digits[:-10], digits[-10:-7], digits[-7:-4], digits[-4:]
        form = [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"00{head} {a} {b} {c}", f"+{head}/{a}/{b}/{c}"][rng.integers(6)]
    return form, 0, len(form)


def none_of_these(rng: np.random.Generator) -> str:
    """A number that is no personal data: a date, a time, a version, an amount, a plain run of digits, a key."""
    n = [int(x) for x in rng.integers(1, 99, 6)]
    run = "".join(map(str, rng.integers(0, 10, int(rng.integers(5, 24)))))
    return [
        f"{1950 + n[0]}-{n[1] % 12 + 1:02}-{n[2] % 28 + 1:02}", f"{n[2] % 28 + 1}.{n[1] % 12 + 1}.{1950 + n[0]}", f"{n[0] % 24:02}:{n[1] % 60:02}:{n[2] % 60:02}",
        f"{n[0]}.{n[1]}.{n[2]}", f"{n[0]},{n[1] * 10:03}.{n[2]:02}", f"{n[0]}.{n[1]}", run, f"{int(run):x}{n[3]}", f"{n[0]} - {n[1]}", f"{1900 + n[0]}-{1900 + n[1]}",
    ][rng.integers(10)]


def examples(text: str, spec: TaggerSpec, rng: np.random.Generator) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The text with its spans; then, around some of its spans, its passage with the value written otherwise,
    and with a number that is no personal data in its place."""
    spans = base_spans(text)
    out = [(text, spans)]
    for k in rng.permutation(len(spans))[: spec.spans]:
        kind, a, b = spans[k]
        before, after = text[max(0, a - AROUND) : a], text[b : b + AROUND]
        # Neighbours that the cut leaves whole keep their labels.
        near = [(s, x, y) for s, x, y in spans if a - len(before) <= x and y <= a or b <= x and y <= b + len(after)]

        def passage(form: str, label: list[tuple[str, int, int]], a=a, b=b, before=before, after=after, near=near) -> tuple[str, list]:
            left = [(s, x - a + len(before), y - a + len(before)) for s, x, y in near if y <= a]
            right = [(s, x - b + len(before) + len(form), y - b + len(before) + len(form)) for s, x, y in near if x >= b]
            return before + form + after, left + [(s, x + len(before), y + len(before)) for s, x, y in label] + right

        for _ in range(spec.variants):
            made = written_otherwise(kind, text[a:b], rng)
            if made:
                out.append(passage(made[0], [(kind, made[1], made[2])]))
        out.append(passage(none_of_these(rng), []))
    return out


def some_windows(text: str, spans: list[tuple[str, int, int]], spec: TaggerSpec, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags of a labelled text: at most ``spec.windows`` that hold a span, and as many that do not."""
    starts = window_starts(text, spec)
    labelled = np.zeros(len(text) + spec.window, np.uint8)
    labelled[: len(text)] = span_tags(len(text), spans)
    sums = np.concatenate([[0], np.cumsum(labelled > 0, dtype=np.int64)])
    holds = sums[starts + spec.window] > sums[starts]
    picked = np.sort(np.concatenate([rng.permutation(np.flatnonzero(which))[: spec.windows] for which in (holds, ~holds)]))
    if not len(picked):
        return np.zeros((0, spec.window), np.uint8), np.zeros((0, spec.window), np.uint8)
    at = starts[picked]
    return windows(text, at, spec), labelled[at[:, None] + np.arange(spec.window)[None]]


def training_windows(texts: list[str], spec: TaggerSpec) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags of texts, labelled by the patterns, with their other writings."""
    found = []
    for text in texts:
        rng = np.random.default_rng([spec.seed, zlib.crc32(text.encode("utf-8", "surrogatepass"))])
        found += [some_windows(t, s, spec, rng) for t, s in examples(text, spec, rng)]
    none = np.zeros((0, spec.window), np.uint8)
    return np.concatenate([none, *(c for c, _ in found)]), np.concatenate([none, *(t for _, t in found)])


def evened(codes: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of each kind are repeated until the kinds are even; windows without spans stand once."""
    which = [np.flatnonzero((tags == 1 + 2 * k).any(1)) for k in range(len(KINDS))]
    most = max([len(w) for w in which] + [1])
    rows = np.concatenate([np.flatnonzero(~(tags > 0).any(1)), *(np.resize(w, most) for w in which if len(w))])
    return codes[rows], tags[rows]


def trained_tagger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spec: TaggerSpec | None = None) -> Tagger | None:
    """A tagger from at most ``spec.sample`` documents that hold a digit or an at sign.

    The spans that label them come from the fixed patterns, in their own and other writings. The
    sample is the smallest hashes of (id, text), so it is the same in every run. Windows are cut
    in the tasks; the driver gets a bounded number for each document. None if no document has any.
    """
    spec = spec or TaggerSpec()
    labelled = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).where(F.col("_text").rlike("[0-9]{2}|@"))
    schema = pa.schema([("h", pa.int64()), ("codes", pa.binary()), ("tags", pa.binary())])

    def cut(batch: pa.RecordBatch) -> dict:
        rows = [training_windows([t], spec) for t in texts_of(batch.column(1))]
        return {"h": batch.column(0), "codes": [c.tobytes() for c, _ in rows], "tags": [t.tobytes() for _, t in rows]}

    hashed = labelled.select(F.xxhash64("_id", "_text").alias("h"), "_text")
    # The bound is found among hashes alone, so no task gathers texts to choose from.
    bound = hashed.select("h").orderBy("h").limit(spec.sample).agg(F.max("h")).first()[0]
    if bound is None:
        return None
    some = hashed.where(F.col("h") <= bound).dropDuplicates(["h"])
    rows = some.mapInArrow(batches(schema, cut), "h long, codes binary, tags binary").collect()
    codes = [np.frombuffer(r["codes"], np.uint8).reshape(-1, spec.window) for r in sorted(rows, key=lambda r: (r["h"], r["codes"]))]
    tags = [np.frombuffer(r["tags"], np.uint8).reshape(-1, spec.window) for r in sorted(rows, key=lambda r: (r["h"], r["codes"]))]
    if not codes or not any(t.any() for t in tags):
        return None
    tagger = Tagger(spec).start()
    tagger.train(*evened(np.concatenate(codes), np.concatenate(tags)))
    tagger.w = {k: v.astype(np.float32) for k, v in tagger.w.items()}
    return tagger


def all_spans(texts: list[str], tagger: Tagger | None) -> list[tuple[list, list]]:
    """For each text the spans of the patterns, and all spans, by start, then kind."""
    base = [base_spans(t) for t in texts]
    if tagger is None:
        return [(b, b) for b in base]
    more = tagged_spans(texts, tagger)
    free = [[s for s in m if all(s[2] <= x or y <= s[1] for _, x, y in b)] for b, m in zip(base, more, strict=True)]
    return [(b, sorted(b + m, key=lambda s: (s[1], KINDS.index(s[0])))) for b, m in zip(base, free, strict=True)]


def _shared(spark: SparkSession, tagger: Tagger | None) -> Broadcast:
    """The tagger's sizes and weights, a few thousand numbers, for all tasks."""
    return spark.sparkContext.broadcast(None if tagger is None else (asdict(tagger.spec), tagger.w))


def _tagger_of(shared: tuple | None) -> Tagger | None:
    return None if shared is None else Tagger(TaggerSpec(**shared[0]), shared[1])


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spec: TaggerSpec | None = None) -> DataFrame:
    """One row per row of ``docs``: counts of the base kinds, base spans, all spans."""
    tagger = _shared(docs.sparkSession, trained_tagger(docs, id_col, text_col, spec))
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_spans", pa.string()), ("spans", pa.string())])

    def rows(batch: pa.RecordBatch) -> dict:
        found = all_spans(texts_of(batch.column(1)), _tagger_of(tagger.value))
        counts = {f"n_{k}": [sum(s[0] == k for s in base) for base, _ in found] for k in KINDS}
        return {"doc_id": batch.column(0), **counts, "base_spans": [joined(b) for b, _ in found], "spans": [joined(a) for _, a in found]}

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(batches(schema, rows), ", ".join(["doc_id long", *(f"n_{k} long" for k in KINDS), "base_spans string", "spans string"]))


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the earlier, longer one counts."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        out.append(text[at : max(a, at)])
        if a >= at:
            out.append(f"<{kind}>")
        at = b
    return "".join(out) + text[at:]


def mask_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", spec: TaggerSpec | None = None) -> DataFrame:
    """``docs`` with personal data replaced by ``<kind>``; all rows and columns stay."""
    tagger = _shared(docs.sparkSession, trained_tagger(docs, id_col, text_col, spec))

    def run(stream):
        for batch in (whole.slice(k, STEP) for whole in stream for k in range(0, len(whole), STEP)):
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).to_pylist()
            spans = all_spans(["" if t is None else t for t in texts], _tagger_of(tagger.value))
            new = [None if t is None else masked(t, s) for t, (_, s) in zip(texts, spans, strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if length_col in batch.schema.names:
                k = batch.schema.get_field_index(length_col)
                columns[k] = pa.array([v if a == b else len(b) for a, b, v in zip(texts, new, batch.column(k).to_pylist(), strict=True)], batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
