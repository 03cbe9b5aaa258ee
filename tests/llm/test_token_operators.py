"""Byte-pair encoding and token files against the tokenizers library."""

import hashlib
import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from sightline.llm.bpe import bpe_digests, bpe_texts, bpe_tokens, merges_of
from sightline.llm.chunks import checked_vocabulary
from sightline.llm.common import scratch_path
from sightline.llm.token_files import read_metadata, read_tokens, token_digests, tokens_round_trip, write_tokens
from tests.llm import helpers as plain

FILE = public_tokenizers.path("word_bpe_49k.json")
RNG = random.Random(3)
LONG = plain.prose(RNG, 20_000)
TEXTS = [
    None, "", "  \t\n", "Hello, World's 'll <|endoftext|>x<|startoftext|>", "ΑΣ İ Å ẛ̣ é", "a" * 3000, "ab" * 1500, "!" * 2000, "\x1c\x1fa\x85b\u3000c", "🎉 日本語 1234",
    LONG, LONG, "</w> <|im_end|>", "\x00\x01 \ufeff", "e\u0301\u08d3 \u0357\u1715 \U00011935\U00011930",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(FILE)
    t.no_truncation()
    t.no_padding()
    return t


def test_merges_match_the_library(library):
    rng = random.Random(5)
    letters = [chr(i) for i in range(0x250)] + list("aaaeeeootsn'''  \n..!!") * 8 + ["<|endoftext|>", "'ll", "Σ", "\u0301", "ﬁ", "中", "🎉", "\x1d"] * 4
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    flat, ends = merges_of(checked_vocabulary(FILE))[1].ids(texts)
    for text, a, b, want in zip(texts, ends, ends[1:], library.encode_batch(texts, add_special_tokens=False)):
        assert flat[a:b].tolist() == want.ids, repr(text)


# Pairs of marks that Python's tables order or compose and the library's do not.
MARKS = ["\u0301\u08d3", "\u0300\u0eba", "\u0357\u1715", "\u082b\u0d3b", "\u0301\u1ac3", "\u0300\U00011f41", "\U00011935\U00011930", "\U00011938"]


def test_every_character_and_mark_matches_the_library(library):
    """Every code point beside a base and marks of all classes, and random runs of marks."""
    rng = random.Random(6)
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)) not in ("Co", "Cn")]
    marks = [c for c in points if unicodedata.combining(c)]
    texts = MARKS + [f"e{m}" for m in MARKS] + [f"a\u0345{c}\u0301" for c in points]
    texts += [f"e{m}\u0323\u0301 {m}\u0345{rng.choice(marks)}" for m in marks]
    texts += ["".join(rng.choice(marks) if rng.random() < 0.7 else rng.choice(points) for _ in range(rng.randint(1, 12))) for _ in range(40_000)]
    chunks = merges_of(checked_vocabulary(FILE))[1]
    for at in range(0, len(texts), 20_000):
        part = texts[at : at + 20_000]
        flat, ends = chunks.ids(part)
        for text, a, b, want in zip(part, ends, ends[1:], library.encode_batch(part, add_special_tokens=False)):
            assert flat[a:b].tolist() == want.ids, ascii(text)


def test_bpe(spark, library):
    df = plain.documents(spark, TEXTS, extra=True)
    got = {r["doc_id"]: r for r in bpe_digests(df, FILE).collect()}
    tokens = bpe_tokens(df, FILE)
    lists = {r["doc_id"]: r["ids"] for r in tokens.collect()}
    back = {r["doc_id"]: r["text"] for r in bpe_texts(tokens, FILE).collect()}
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert got[i]["n_tokens"] == len(ids) and lists[i] == ids and back[i] == text
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe_digests(df.limit(0), FILE).count() == 0


def test_token_files(spark, library):
    texts = [t for t in TEXTS for _ in range(3)]
    df = plain.documents(spark, texts, extra=True)
    want, start = {}, 0
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokens_round_trip(df, FILE).collect()}
    assert got == want
    assert tokens_round_trip(df.limit(0), FILE).count() == 0


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_encoding_and_selective_reads(spark, encoding):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, plain.prose(rng, 60)) for i in range(400)] + [(None, "x"), (5, "twice")], "doc_id long, text string")
    path = scratch_path(spark, "token-test")
    write_tokens(df.repartition(2), path, FILE, encoding=encoding, row_group_bytes=1 << 14, page_bytes=1 << 10, page_rows=16)
    files = [p for p in spark.read.parquet(path).inputFiles()]
    meta = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in files]
    column = next(m.row_group(0).column(4) for m in meta if m.num_rows)
    assert ("DELTA_BINARY_PACKED" if encoding == "delta" else "RLE_DICTIONARY" if "RLE_DICTIONARY" in column.encodings else "PLAIN_DICTIONARY") in column.encodings
    assert column.has_offset_index and any(m.num_row_groups > 1 for m in meta)
    some = read_tokens(spark, path, 10, 19)
    assert sorted(r["doc_id"] for r in some.collect()) == list(range(10, 20))
    rows = read_metadata(spark, path).orderBy("start").collect()
    assert rows[0]["doc_id"] is None and [r["doc_id"] for r in rows[1:]] == sorted([*range(400), 5])
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:]))
    scan = read_metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in scan
    assert token_digests(spark, path).count() == 402
    with pytest.raises(ValueError):
        write_tokens(df, path, FILE, encoding="other")
