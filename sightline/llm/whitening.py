"""Whitening of embedding vectors by a covariance weighted with multiplicities.

1. Each valid vector becomes a vector x of whole numbers, kept as its shortest code.
2. Equal codes are grouped, partly before the shuffle, so copies cost one row; the number of
   copies (or one) is the vector's weight in the fit.
3. Weighted sums per dimension, then a weighted centred matrix product per task, summed by
   matrix row in Spark. The driver gets d rows of d numbers, whatever the number of vectors.
4. Each distinct vector is whitened once. Its result is joined back to its rows by code; codes
   with a 256th of all rows or more (at most 256) are broadcast, so no copy group fills a task.

Defined cases: null vectors, vectors with null, infinite or NaN entries, and vectors whose
entries lie beyond +-2^30 are left out; so are vectors of another length than the most
frequent one (of equally frequent ones the longest). Repeated rows each count and are each
returned, null ids too. A component without variance (its eigenvalue is not above 1e-13 of
the trace, so every one if all vectors are equal) has null as whitened value, and explained is
null if the trace is zero; ``identity_error`` is taken over the others, zero if there is none.
An empty table gives no rows. Other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import spread_join, written

ENTRY_LIMIT = float(1 << 30)
WIDTHS = (np.int16, np.int32, np.int64)
FLAT = 1e-13


@dataclass(frozen=True)
class WhitenSpec:
    """x = floor(scale * c) + offset; ``weights`` is 'counts' (fit on all vectors) or 'one' (on each
    distinct one once)."""

    components: int = 8
    scale: float = 1024.0
    offset: int = 100_000
    weights: str = "counts"

    def __post_init__(self):
        if self.weights not in ("counts", "one"):
            raise ValueError("weights are 'counts' or 'one'")


def coded(vector: np.ndarray) -> bytes:
    """Shortest code of whole numbers: a width byte, then the numbers."""
    reach = int(np.abs(vector).max()) if len(vector) else 0
    for k, kind in enumerate(WIDTHS):
        if reach <= np.iinfo(kind).max:
            break
    return bytes([k]) + vector.astype(kind).tobytes()


def decoded(codes: list[bytes], dims: int) -> np.ndarray:
    """Matrix of whole numbers, one row per code."""
    out = np.empty((len(codes), dims), np.int64)
    for k, code in enumerate(codes):
        out[k] = np.frombuffer(code, WIDTHS[code[0]], offset=1)
    return out


def codes(embeddings: DataFrame, id_col: str, vec_col: str, spec: WhitenSpec) -> DataFrame:
    """(vec_id, dims, code) of the valid vectors; the code holds x less the offset."""
    schema = pa.schema([("vec_id", pa.int64()), ("dims", pa.int32()), ("code", pa.binary())])

    def run(stream):
        for whole in stream:
            for at in range(0, len(whole), 1024):
                batch = whole.slice(at, 1024)
                vectors = batch.column(1)
                ids, kept, dims, out = batch.column(0).to_pylist(), [], [], []
                sizes = np.array([-1 if v is None else v for v in vectors.value_lengths().to_pylist()], np.int64)
                flat = vectors.flatten()  # null vectors take no room here
                values = np.asarray(flat.fill_null(np.nan).to_numpy(zero_copy_only=False), np.float64)
                ends = np.cumsum(np.maximum(sizes, 0))
                with np.errstate(invalid="ignore"):
                    sound = np.abs(values) < ENTRY_LIMIT
                    x = np.floor(values * spec.scale)
                bad = np.append(0, np.cumsum(~sound))
                for i, (n, end) in enumerate(zip(sizes.tolist(), ends.tolist())):
                    if n > 0 and bad[end] == bad[end - n]:
                        kept.append(ids[i])
                        dims.append(n)
                        out.append(coded(x[end - n : end].astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], schema=schema)

    picked = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    return picked.mapInArrow(run, "vec_id long, dims int, code binary")


def _summed(parts: DataFrame, d: int) -> np.ndarray:
    """Sum of (row, values) over all tasks: at most d rows of d numbers come to the driver."""
    schema = pa.schema([("row", pa.int32()), ("values", pa.binary())])

    def run(stream):
        total: dict[int, np.ndarray] = {}
        for batch in stream:
            for row, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[row] = total.get(row, 0.0) + np.frombuffer(data)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], schema=schema)

    out = np.zeros((d, d))
    for r in parts.repartition("row").mapInArrow(run, "row int, values binary").collect():
        out[r["row"]] = np.frombuffer(r["values"])
    return out


def _matrix_rows(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(total)), pa.int32()), pa.array([r.tobytes() for r in np.ascontiguousarray(total)], pa.binary())], names=["row", "values"]
    )


def weighted_covariance(rows: DataFrame, read, mean: np.ndarray, n: int) -> np.ndarray:
    """Covariance of the matrices ``read(column)`` gives, with weights, centred before multiplying.

    ``rows`` has the data and the weight, in this order.
    """
    d = len(mean)

    def run(stream):
        total = np.zeros((d, d))
        for whole in stream:
            for at in range(0, len(whole), 1024):
                batch = whole.slice(at, 1024)
                x = read(batch.column(0)) - mean
                total += (x * batch.column(1).to_numpy()[:, None]).T @ x
        yield _matrix_rows(total)

    return _summed(rows.mapInArrow(run, "row int, values binary"), d) / n


def _sums(rows: DataFrame, d: int) -> list[int]:
    """Exact weighted sums per dimension of the codes."""
    schema = pa.schema([("dim", pa.int32()), ("total", pa.decimal128(38, 0))])

    def run(stream):
        total = [0] * d
        for whole in stream:
            for at in range(0, len(whole), 1024):
                batch = whole.slice(at, 1024)
                x, w = decoded(batch.column(0).to_pylist(), d), batch.column(1).to_numpy()
                # Low and high halves, so that a slice's products stay within 64 bits.
                low, high = w & 0xFFFF, w >> 16
                part, more = (x * low[:, None]).sum(axis=0), (x * high[:, None]).sum(axis=0)
                total = [t + a + (b << 16) for t, a, b in zip(total, part.tolist(), more.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(total, pa.decimal128(38, 0))], schema=schema)

    found = rows.mapInArrow(run, "dim int, total decimal(38,0)").groupBy("dim").agg(F.sum("total").alias("total")).collect()
    out = [0] * d
    for r in found:
        out[r["dim"]] = int(r["total"])
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Exact sum over dimensions of (n*x - S)^2 for each row."""
    # n*x - S = n*(x - q) - r with S = n*q + r, so all parts are small; the square is n^2 a - 2 n b + c.
    q = np.array([s // n for s in sums], np.int64)
    r = [s % n for s in sums]
    near = x - q
    squares = [int(v) for v in (near * near).sum(axis=1)] if np.abs(near).max(initial=0) < 1 << 28 else [sum(v * v for v in row) for row in near.tolist()]
    if n < 1 << 24 and np.abs(near).max(initial=0) < 1 << 28:
        mixed = (near * np.array(r, np.int64)).sum(axis=1).tolist()
    else:
        mixed = [sum(a * b for a, b in zip(row, r)) for row in near.tolist()]
    c = sum(v * v for v in r)
    return [n * n * a - 2 * n * b + c for a, b in zip(squares, mixed)]


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", spec: WhitenSpec | None = None) -> DataFrame:
    """One row per valid row: vec_id, n (the length of the fit list), deviation (decimal, exact),
    whitened and explained (arrays over components by falling eigenvalue) and identity_error."""
    spec = spec or WhitenSpec()
    out = "vec_id long, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    spark = embeddings.sparkSession
    rows = codes(embeddings, id_col, vec_col, spec)
    stored = written(rows.groupBy("dims", "code").agg(F.count("*").alias("copies")), "whiten-codes")
    lengths = stored.groupBy("dims").agg(F.sum("copies").alias("rows"), F.count("*").alias("kinds")).orderBy(F.desc("rows"), F.desc("dims")).first()
    if lengths is None:
        return spark.createDataFrame([], out)
    d, total = lengths["dims"], lengths["rows"]
    weight = F.col("copies") if spec.weights == "counts" else F.lit(1).cast("long")
    n = total if spec.weights == "counts" else lengths["kinds"]
    distinct = stored.where(F.col("dims") == d)
    fit = distinct.select("code", weight.alias("weight"))

    base = _sums(fit, d)  # without the offset, which changes no difference
    whole, part = np.array([s // n for s in base], np.int64), np.array([(s % n) / n for s in base])

    def read(column: pa.Array) -> np.ndarray:
        return (decoded(column.to_pylist(), d) - whole).astype(np.float64)

    cov = weighted_covariance(fit, read, part, n)
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    k = min(spec.components, d)
    values, vectors = np.maximum(values[::-1][:k], 0.0), vectors[:, ::-1][:, :k]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])
    trace = float(np.trace(cov))
    live = values > FLAT * trace
    scaled = np.where(live, vectors / np.sqrt(np.where(live, values, 1.0)), 0.0)
    schema = pa.schema(
        [("code", pa.binary()), ("copies", pa.int64()), ("weight", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("white", pa.binary())]
    )

    def project(stream):
        for all_rows in stream:
            for at in range(0, len(all_rows), 1024):
                batch = all_rows.slice(at, 1024)
                x = decoded(batch.column(0).to_pylist(), d)
                white = np.ascontiguousarray(((x - whole) - part) @ scaled)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), batch.column(2), pa.array(deviations(x, n, base), pa.decimal128(38, 0)), pa.array([r.tobytes() for r in white], pa.binary())],
                    schema=schema,
                )

    made = distinct.select("code", "copies", weight.alias("weight")).mapInArrow(
        project, "code binary, copies long, weight long, deviation decimal(38,0), white binary"
    )
    made = written(made, "whiten-made")

    def numbers(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist())).reshape(-1, k)

    def mean_rows(stream):
        sums = np.zeros((1, k))
        for batch in stream:
            if len(batch):
                sums += batch.column(1).to_numpy() @ numbers(batch.column(0))
        yield _matrix_rows(sums)

    white = made.select("white", "weight")
    mean = _summed(white.mapInArrow(mean_rows, "row int, values binary"), k)[0] / n
    check = weighted_covariance(white, numbers, mean, n) - np.eye(k)
    error = float(np.abs(check[np.ix_(live, live)]).max(initial=0.0))
    explained = F.array(*[F.lit(float(v / trace) if trace > 0 else None).cast("double") for v in values])
    joined = spread_join(rows.select("vec_id", "code"), made.select("code", "copies", "deviation", "white"), "code", "copies", total)
    unpack_schema = pa.schema(
        [("vec_id", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.list_(pa.float64()))]
    )

    def unpack(stream):
        for batch in stream:
            got = numbers(batch.column(2))
            flat = pa.array(got.ravel(), mask=np.tile(~live, len(got)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1) * k, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], schema=unpack_schema)

    shown = joined.select("vec_id", "deviation", "white").mapInArrow(unpack, "vec_id long, deviation decimal(38,0), whitened array<double>")
    return shown.select(
        "vec_id", F.lit(int(n)).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error")
    )


def whitened_components(embeddings: DataFrame, **options) -> DataFrame:
    """``whiten`` with one row per vector and component, numbered from 1.

    ``deviation`` is null where it does not fit a long.
    """
    rows = whiten(embeddings, **options)
    return rows.select(
        "vec_id", "n", F.expr("try_cast(deviation AS long)").alias("deviation"), "identity_error",
        F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "pair"),
    ).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("pair.whitened").alias("whitened"),
        F.col("pair.explained").alias("explained"), "identity_error",
    )
