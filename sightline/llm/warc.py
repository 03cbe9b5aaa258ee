"""WARC archives with a two-level capture index.

Writing: each task streams its pages into gzip members of an archive of its own. Of equal
payloads the one with the largest id is a response, the others refer to it. The catalogue
(one row per record) is written last by Spark and names the files that count, so what a
lost or repeated task left behind is never read.

Index: capture lines, sorted by reversed-host key, are dealt by key range into shards; a shard
is a file of compressed blocks of lines, and a sparse directory keeps each block's first key
and place. A lookup finds the shard by binary search among the shards' first keys, the block by
binary search in the shard's directory, reads that byte range, and searches the block.

Defined cases: null html is an empty payload; a null URL has an empty key; records of repeated
rows are all written and all found under their key; rows that share the largest id of a
payload are all responses; an empty table gives an empty index; other columns are never read.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import scratch_path, written

EMPTY_KEY = "-"
CATALOGUE = "key string, file string, offset long, length long"


@dataclass(frozen=True)
class ArchiveSpec:
    """``least`` bytes make a payload worth a reference; a new archive begins after ``file_bytes``;
    a block holds ``block_lines`` capture lines; ``date`` stands in every record."""

    least: int = 1000
    file_bytes: int = 256 << 20
    block_lines: int = 512
    level: int = 3
    date: str = "2024-01-01T00:00:00Z"


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


URL = re.compile(r"(?s)^.*?://(?P<host>[^/?#:]*)(?P<port>[^/?#]*)(?P<rest>.*)$")


def reversed_host_key(url: str | None, page_id: int | None) -> str:
    """com,example,www)/path?query and the id, in an order that is that of its bytes."""
    m = URL.match(url or "")
    if m:
        host = ",".join(reversed(m["host"].lower().split(".")))
        key = f"{host}{m['port']}){m['rest'] or '/'}"
    else:
        key = url or EMPTY_KEY
    return quote(key, safe="!$&'()*+,/:;=?@#[]%|~-._") + " " + ("-" if page_id is None else f"{page_id + (1 << 63):020d}")


# ---- writing ----


def with_references(pages: DataFrame, id_col: str, url_col: str, html_col: str, spec: ArchiveSpec) -> DataFrame:
    """(page_id, url, html, digest, refers_to). Payloads that occur once never leave their row's join partner empty-handed."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    keyed = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    large = keyed.where(F.octet_length("html") >= spec.least)
    latest = large.groupBy("digest").agg(F.max("page_id").alias("latest"), F.count("*").alias("n")).where("n > 1 AND latest IS NOT NULL").select("digest", "latest")
    return keyed.join(latest, "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("latest")), F.col("latest")).alias("refers_to")
    )


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, spec: ArchiveSpec) -> bytes:
    """One WARC record; a revisit has the HTTP header, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {spec.date}",
        f"WARC-Target-URI: {quote(url or '', safe=chr(37) + '!$&()*+,/:;=?@#[]~-._')}", f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}", "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, spec: ArchiveSpec | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write archives under ``folder``; returns the catalogue (key, file, offset, length)."""
    spec = spec or ArchiveSpec()
    schema = pa.schema([("key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(stream):
        system, root = place(folder)
        system.create_dir(root, recursive=True)
        task = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        out, number, offset, name = None, 0, 0, ""
        try:
            for batch in (whole.slice(k, 256) for whole in stream for k in range(0, len(whole), 256)):
                rows: list[tuple] = []
                for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or offset >= spec.file_bytes:
                        if out is not None:
                            out.close()
                        name, offset = f"pages-{task}-{number:04d}.warc.gz", 0
                        out, number = system.open_output_stream(f"{root}/{name}", compression=None), number + 1
                    data = gzip.compress(record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers_to, spec), spec.level, mtime=0)
                    out.write(data)
                    rows.append((reversed_host_key(url, page_id), name, offset, len(data)))
                    offset += len(data)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(schema.types)], schema=schema)
        finally:
            if out is not None:
                out.close()

    records = with_references(pages, id_col, url_col, html_col, spec)
    return written(records.mapInArrow(run, CATALOGUE), "warc-catalogue")


# ---- index ----

DIRECTORY = "shard int, first string, file string, offset long, length long"


def write_index(catalogue: DataFrame, folder: str, spec: ArchiveSpec | None = None) -> DataFrame:
    """Write the blocks of sorted capture lines; returns the directory (shard, first, file, offset, length)."""
    spec = spec or ArchiveSpec()
    schema = pa.schema([("shard", pa.int32()), ("first", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(stream):
        system, root = place(folder)
        system.create_dir(root, recursive=True)
        shard = TaskContext.get().partitionId()
        name = f"captures-{shard:06d}-{uuid.uuid4().hex}.idx"
        out, offset = None, 0
        lines: list[str] = []
        first = ""

        def block() -> pa.RecordBatch:
            nonlocal out, offset
            if out is None:
                out = system.open_output_stream(f"{root}/{name}", compression=None)
            data = zlib.compress("\n".join(lines).encode(), 6)
            out.write(data)
            row = (shard, first, name, offset, len(data))
            offset += len(data)
            lines.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types, strict=True)], schema=schema)

        try:
            for batch in stream:
                for key, file, at, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if not lines:
                        first = key
                    lines.append(f"{key} {json.dumps([file, at, length])}")
                    if len(lines) == spec.block_lines:
                        yield block()
            if lines:
                yield block()
        finally:
            if out is not None:
                out.close()

    ordered = catalogue.repartitionByRange("key").sortWithinPartitions("key", "file", "offset")
    return written(ordered.select("key", "file", "offset", "length").mapInArrow(run, DIRECTORY), "warc-directory")


def look_up(queries: DataFrame, directory: DataFrame, folder: str) -> DataFrame:
    """(key, file, offset, length) of every capture of every key in ``queries`` (key).

    The driver holds the first and last block's first key of each shard, a row per index file.
    A shard's directory is streamed to its task before the queries that fall into it.
    """
    tops = sorted((r["first"], r["shard"]) for r in directory.groupBy("shard").agg(F.min("first").alias("first")).collect())
    firsts = [f for f, _ in tops]
    dealt = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def deal(stream):
        for batch in stream:
            keys, shards = [], []
            for key in batch.column(0).to_pylist():
                # Captures of one key may run over the border of two shards or more.
                low, high = bisect.bisect_left(firsts, key) - 1, bisect.bisect_right(firsts, key) - 1
                for k in range(max(low, 0), high + 1):
                    keys.append(key)
                    shards.append(tops[k][1])
            n = len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array([1] * n, pa.int32()), pa.array(keys, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], schema=dealt)

    def search(stream):
        system, root = place(folder)
        files: dict[str, object] = {}
        shard, starts, blocks = None, [], []
        at, lines, keys = -1, [], []

        def load(k: int) -> None:
            nonlocal at, lines, keys
            if k == at:
                return
            file, offset, length = blocks[k]
            if file not in files:
                for f in files.values():
                    f.close()
                files.clear()
                files[file] = system.open_input_file(f"{root}/{file}")
            files[file].seek(offset)
            lines = zlib.decompress(files[file].read(length)).decode().split("\n")
            keys = [x[: x.index(" ", x.index(" ") + 1)] for x in lines]
            at = k

        for batch in stream:
            found: list[tuple] = []
            for s, kind, key, file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != shard:
                    shard, starts, blocks, at = s, [], [], -1
                if kind == 0:
                    starts.append(key)
                    blocks.append((file, offset, length))
                    continue
                k = max(bisect.bisect_left(starts, key) - 1, 0)
                while k < len(starts) and starts[k] <= key:
                    load(k)
                    for i in range(bisect.bisect_left(keys, key), bisect.bisect_right(keys, key)):
                        found.append((key, *json.loads(lines[i][len(key) + 1 :])))
                    k += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["key", "file", "offset", "length"])

    asked = queries.select("key").distinct().mapInArrow(deal, "shard int, kind int, key string, file string, offset long, length long")
    known = directory.select("shard", F.lit(0).alias("kind"), F.col("first").alias("key"), "file", "offset", "length")
    both = known.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind", "key", "offset")
    return both.mapInArrow(search, CATALOGUE)


# ---- reading ----

RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(record fields, HTTP header, payload) of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *fields = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    named = dict(f.split(": ", 1) if ": " in f else (f.rstrip(":"), "") for f in fields)
    block = rest[: int(named["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return named, http, payload


def read_records(located: DataFrame, folder: str, stretch: int = 32 << 20) -> DataFrame:
    """The records at (file, offset, length), read by byte range, each task's in file order.

    A task reads about ``stretch`` bytes of archives: the locations are written once, so that
    their number and ranges follow the records' lengths and not the locations' own size.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(stream):
        system, root = place(folder)
        name, held = None, None
        try:
            for batch in (whole.slice(k, 1024) for whole in stream for k in range(0, len(whole), 1024)):
                rows: list[tuple] = []
                for file, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    if file != name:
                        if held is not None:
                            held.close()
                        name, held = file, system.open_input_file(f"{root}/{file}")
                    held.seek(offset)
                    named, http, payload = parse(gzip.decompress(held.read(length)))
                    digest = named["WARC-Payload-Digest"].removeprefix("sha1:")
                    refers = named.get("X-Refers-To-Page-ID")
                    size = int(http.decode().partition("Content-Length: ")[2].split("\r\n")[0])
                    if refers is None and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"{file} at {offset}: payload and digest differ")
                    page = named["X-Page-ID"]
                    rows.append((int(page) if page else None, named["WARC-Target-URI"], size, digest, named["WARC-Type"], int(refers) if refers else None))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(schema.types)], schema=schema)
        finally:
            if held is not None:
                held.close()

    located = written(located.select("file", "offset", "length"), "warc-located")
    total = located.agg(F.sum("length")).first()[0] or 0
    tasks = max(-(-total // stretch), located.sparkSession.sparkContext.defaultParallelism)
    return located.repartitionByRange(int(tasks), "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(run, RECORDS)


def query_keys(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The capture keys of pages."""

    def run(stream):
        for batch in stream:
            keys = [reversed_host_key(u, i) for i, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string())], names=["key"])

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string")).mapInArrow(run, "key string")


def archive_round_trip(pages: DataFrame, spec: ArchiveSpec | None = None) -> DataFrame:
    """Write archives and index to the shared folder, look every page up, read its record."""
    spark: SparkSession = pages.sparkSession
    folder = scratch_path(spark, "warc")
    catalogue = write_archives(pages, folder, spec)
    directory = write_index(catalogue, folder, spec)
    return read_records(look_up(query_keys(pages), directory, folder), folder)
