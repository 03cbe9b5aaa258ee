"""Token ids as Parquet list columns, written in id order and read selectively.

Files hold (part, doc_id, start, n_tokens, ids): ``start`` counts the ids before a document
within its file's part. Ids are dictionary-encoded (or delta-encoded, by parameter); row
groups and pages are small enough that the column and offset indexes on doc_id lead to a
few pages. Offsets over all parts come from the two metadata columns alone.

Defined cases: a null or empty text has only the end id; rows that share an id are written
next to each other, ordered by text; a null id comes first; an empty table gives empty files.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sightline.llm.chunks import ChunkIds, Rules, checked_vocabulary
from sightline.llm.common import scratch_path, texts_of, worker_store

#: Words that are encoded as one text, and chunks and words whose ids a worker keeps (about 180 bytes each).
LINE = 64
WORKER_HELD = 800_000

ROWS = "part int, doc_id long, start long, n_tokens long, ids array<int>"

def library_ids(raw: str) -> ChunkIds:
    """Ids by the tokenizers library, made once per worker."""
    held, key = worker_store(), hashlib.sha256(raw.encode()).hexdigest()
    if held.get("library", ("",))[0] != key:
        # Words come normalised by the rules; normalising them again could change them.
        library = Tokenizer.from_str(json.dumps(json.loads(raw) | {"normalizer": None}))

        def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            # 64 words a text: the library numbers the words of a text, and none is cut in two.
            lines = [" ".join(words[k : k + LINE]) for k in range(0, len(words), LINE)]
            found = library.encode_batch(lines, add_special_tokens=False)
            ids = [e.ids for e in found]
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            total = int(counts.sum())
            number = np.fromiter(chain.from_iterable(e.word_ids for e in found), np.int64, total) + np.repeat(np.arange(len(ids)) * LINE, counts)
            return np.fromiter(chain.from_iterable(ids), np.int32, total), np.bincount(number, minlength=len(words))

        held["library"] = key, ChunkIds(Rules(raw), encode, WORKER_HELD)
    return held["library"][1]


def encoded_rows(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of the token files, in id order over the parts."""
    raw = docs.sparkSession.sparkContext.broadcast(checked_vocabulary(vocabulary))
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(stream):
        part, start, store = TaskContext.get().partitionId(), 0, library_ids(raw.value)
        for batch in (whole.slice(k, 256) for whole in stream for k in range(0, len(whole), 256)):
            flat, ends = store.ids(texts_of(batch.column(1)))
            flat = np.insert(flat, ends[1:], end_id)
            ends = ends + np.arange(len(ends))
            counts = np.diff(ends)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(counts), part), pa.int32()), batch.column(0), pa.array(start + ends[:-1], pa.int64()), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))],
                schema=schema,
            )
            start += int(ends[-1])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, ROWS)


def write_tokens(
    docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
    encoding: str = "dictionary", row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10, page_rows: int = 512,
) -> None:
    """Write the token files of ``docs`` under ``path``."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding}")
    writer = encoded_rows(docs, vocabulary, end_id, id_col, text_col).write
    options = {
        "parquet.enable.dictionary": encoding == "dictionary", "parquet.writer.version": "v1" if encoding == "dictionary" else "v2",
        "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": page_rows, "compression": "zstd",
    }
    for key, value in options.items():
        writer = writer.option(key, str(value).lower())
    writer.parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part, start, n_tokens) with starts over all parts; the ids are not read.

    One row per part passes through the running sum.
    """
    rows = spark.read.schema(ROWS).parquet(path).select("part", "doc_id", "start", "n_tokens")
    return rows.join(_offsets(rows), "part").select("doc_id", "part", (F.col("start") + F.col("before")).alias("start"), "n_tokens")


def _offsets(rows: DataFrame) -> DataFrame:
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """(doc_id, ids) of ids from ``low`` to ``high``: the bounds reach row groups and pages."""
    rows = spark.read.schema(ROWS).parquet(path).select("doc_id", "ids")
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    return rows if high is None else rows.where(F.col("doc_id") <= high)


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from the token files."""
    rows = spark.read.schema(ROWS).parquet(path)
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(stream):
        for batch in stream:
            column = batch.column(4)
            flat = column.values.to_numpy().astype("<u4", copy=False)
            ends = column.offsets.to_numpy()
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            counts = pa.array(np.diff(ends), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), counts, pa.array(sums, pa.int64())], schema=schema)

    found = rows.mapInArrow(run, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return found.join(_offsets(rows.select("part", "n_tokens")), "part").select(
        "doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def tokens_round_trip(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write token files to the shared folder and read their digests back."""
    path = scratch_path(docs.sparkSession, "token-files")
    write_tokens(docs, path, vocabulary, end_id)
    return token_digests(docs.sparkSession, path)
