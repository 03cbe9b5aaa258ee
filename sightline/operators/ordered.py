"""Order-dependent operators that split a key's timeline into time buckets.

A key may hold a large share of all rows, so no operator here sends a whole key
to one task. Rows are shuffled by (key, bucket); what crosses bucket borders is
a small table with a few rows per bucket, chained per key, and handed back.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sightline.operators import kernels
from sightline.session import checkpointed

MICROS = 1_000_000
BUCKET_GAPS = 32  # a bucket spans this many cooldown lengths at most
MIN_BUCKET = 3600 * MICROS
DAY = 86400 * MICROS
BUCKET_ROWS = 1_000_000  # rows of a key that a bucket should hold at most


def _micros(seconds: float) -> int:
    return int(round(seconds * MICROS))


def _bucket(width: int) -> Column:
    return F.expr(f"(_t - pmod(_t, {width}L)) div {width}L")


def fitting_width(df: DataFrame, keys: list[str], ts: str, widest: int, least: int = MICROS) -> int:
    """The widest bucket in which no key has more than BUCKET_ROWS rows, ``least`` at the least.

    Each look is a count per (key, bucket), combined before the shuffle. Results do not
    depend on the width, only the size of tasks does.
    """
    times = df.where(F.col(ts).isNotNull()).select(*keys, F.unix_micros(F.col(ts)).alias("_t"))
    width = widest
    while width > least:
        counts = times.groupBy(*keys, _bucket(width).alias("_bucket")).agg(F.count(F.lit(1)).alias("n"))
        fullest = counts.agg(F.max("n")).first()[0] or 0
        if fullest <= BUCKET_ROWS:
            break
        width = max(least, width >> max(1, math.ceil(math.log2(fullest / BUCKET_ROWS))))
    return width


def _width(df: DataFrame, keys: list[str], ts: str, bucket_seconds: float | None) -> int:
    return _micros(bucket_seconds) if bucket_seconds else fitting_width(df, keys, ts, DAY)


def _timed(df: DataFrame, ts: str, width: int) -> DataFrame:
    return df.withColumn("_t", F.unix_micros(F.col(ts))).withColumn("_bucket", _bucket(width))


def _schema(df: DataFrame, names: list[str], extra: str) -> T.StructType:
    keys = [df.schema[n] for n in names]
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in keys] + list(T._parse_datatype_string(extra)))


def _walk(df: DataFrame, by: list[str], order: list[str], make, schema: T.StructType) -> DataFrame:
    """Shuffle by ``by``, sort inside partitions, run an Arrow helper."""
    rows = df.repartition(*by).sortWithinPartitions(*by, *order)
    return rows.mapInArrow(make, schema)


def cooldown(
    df: DataFrame,
    keys: list[str],
    ts: str,
    seconds: float,
    order: list[str],
    strict: bool = False,
    bucket_seconds: float | None = None,
) -> DataFrame:
    """Keep a key's first row and then each row at least ``seconds`` after the
    last *kept* row (more than ``seconds`` when ``strict``); ``order`` breaks ties.

    Two shuffles: a slim one of (key, time) that finds, per bucket, where each
    possible first kept row leads, and one of the full rows that applies it. A bucket is no
    narrower than two gaps; keys with more rows than a bucket should hold even then are
    resolved by ``pointer_cooldown``.
    """
    gap = _micros(seconds) + (1 if strict else 0)
    if bucket_seconds:
        width = _micros(bucket_seconds)
    else:
        least = max(2 * gap, MICROS)
        width = fitting_width(df, keys, ts, max(BUCKET_GAPS * gap, MIN_BUCKET), least)
        if width == least and gap > 0:
            timed = _timed(df.where(F.col(ts).isNotNull()), ts, width)
            crowded = timed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET_ROWS)
            crowded = checkpointed(crowded.select(_key_text(keys).alias("_k")).distinct())
            if crowded.count():
                marked = df.withColumn("_k", _key_text(keys))
                usual = marked.join(crowded, "_k", "left_anti").drop("_k")
                rest = cooldown(usual, keys, ts, seconds, order, strict, width / MICROS)
                return rest.unionByName(pointer_cooldown(marked.join(crowded, "_k", "left_semi").drop("_k"), keys, ts, gap, order))
    timed = _timed(df.where(F.col(ts).isNotNull()), ts, width)

    steps_schema = _schema(df, keys, "_bucket long, _entry long, _exit long")
    carry_schema = _schema(df, keys, "_bucket long, _t long")
    slim = timed.select(*keys, "_bucket", "_t")
    steps = _walk(
        slim, keys + ["_bucket"], ["_t"],
        kernels.cooldown_steps(keys, gap, width, to_arrow_schema(steps_schema)), steps_schema,
    )
    carry = _walk(
        steps, keys, ["_bucket", "_entry"],
        kernels.cooldown_chain(keys, gap, width, to_arrow_schema(carry_schema)), carry_schema,
    )
    rows = timed.withColumn("_flag", F.lit(1)).unionByName(
        carry.withColumn("_flag", F.lit(0)), allowMissingColumns=True
    )
    return _walk(
        rows, keys + ["_bucket"], ["_flag", "_t", *order],
        kernels.cooldown_keep(keys, gap, df.columns), df.schema,
    )


def _key_text(keys: list[str]) -> Column:
    return F.to_json(F.struct(*keys))


def next_times(times: DataFrame, gap: int, width: int) -> DataFrame:
    """(_k, _t, _next): of each distinct (_k, _t) the key's first time at least ``gap`` later, where there is one.

    Times and the wishes ``_t + gap`` are dealt to cells of ``width`` and walked from late to early;
    where a cell has no time left, the first one of the key's next cell that has any is it.
    """

    def cell(x: str) -> Column:
        return F.expr(f"({x} - pmod({x}, {width}L)) div {width}L").alias("_cell")

    rows = times.select("_k", cell("_t"), F.col("_t").alias("_x"), F.col("_t").alias("_own"), F.lit(None).cast("long").alias("_from"))
    wish = times.withColumn("_x", F.col("_t") + gap).select("_k", cell("_x"), "_x", F.lit(None).cast("long").alias("_own"), F.col("_t").alias("_from"))
    points = rows.unionByName(wish)
    # Late ones first; at the same time a row comes before a wish, which it fulfils.
    back = W.partitionBy("_k", "_cell").orderBy(F.desc("_x"), F.col("_own").isNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = points.withColumn("_inside", F.min("_own").over(back)).where("_from IS NOT NULL")
    firsts = points.groupBy("_k", "_cell").agg(F.min("_own").alias("_first"))
    beyond = W.partitionBy("_k").orderBy(F.desc("_cell")).rowsBetween(W.unboundedPreceding, -1)
    later = firsts.select("_k", "_cell", F.min("_first").over(beyond).alias("_later"))
    joined = found.join(later, ["_k", "_cell"])
    return joined.select("_k", F.col("_from").alias("_t"), F.coalesce("_inside", "_later").alias("_next")).where("_next IS NOT NULL")


def pointer_cooldown(df: DataFrame, keys: list[str], ts: str, gap: int, order: list[str]) -> DataFrame:
    """``cooldown`` for keys with very many rows within a gap.

    Every time points to the key's next possible kept time. Pointers are doubled: after k rounds
    the first 2^k kept times of each key are known, so rounds grow with the logarithm of the
    longest chain, and each is a join by (key, time), which no key fills.
    """
    timed = df.where(F.col(ts).isNotNull()).withColumn("_k", _key_text(keys)).withColumn("_t", F.unix_micros(F.col(ts)))
    times = checkpointed(timed.select("_k", "_t").distinct())
    width = fitting_width(times.withColumn("_ts", F.timestamp_micros("_t")), ["_k"], "_ts", gap, 1)
    jump = checkpointed(next_times(times, gap, width))
    kept = checkpointed(times.groupBy("_k").agg(F.min("_t").alias("_t")))
    n = kept.count()
    while n:
        reached = kept.join(jump, ["_k", "_t"]).select("_k", F.col("_next").alias("_t"))
        more = checkpointed(kept.unionByName(reached))
        n, before = more.count(), n
        if n == before:
            break
        kept = more
        far = jump.select("_k", F.col("_t").alias("_next"), F.col("_next").alias("_far"))
        jump = checkpointed(jump.join(far, ["_k", "_next"]).select("_k", "_t", F.col("_far").alias("_next")))
    nth = F.row_number().over(W.partitionBy("_k", "_t").orderBy(*order))
    return timed.join(kept, ["_k", "_t"], "left_semi").withColumn("_n", nth).where("_n = 1").select(*df.columns)


def smoothed_rate(
    df: DataFrame, keys: list[str], ts: str, order: list[str], keep: float = 0.9, bucket_seconds: float | None = None
) -> DataFrame:
    """Append ``rate``: keep·previous + (1−keep)/Δt over each key's rows in time order.

    Steps of zero length leave the rate unchanged; the first row has rate 0.
    """
    gain = round(1.0 - keep, 12)
    width = _width(df, keys, ts, bucket_seconds)
    timed = _timed(df.where(F.col(ts).isNotNull()), ts, width)
    sum_schema = _schema(df, keys, "_bucket long, _first long, _last long, _scale double, _shift double")
    carry_schema = _schema(df, keys, "_bucket long, _t long, _rate double")
    summary = _walk(
        timed.select(*keys, "_bucket", "_t"), keys + ["_bucket"], ["_t"],
        kernels.rate_summary(keys, keep, gain, to_arrow_schema(sum_schema)), sum_schema,
    )
    carry = _walk(
        summary, keys, ["_bucket"],
        kernels.rate_chain(keys, keep, gain, to_arrow_schema(carry_schema)), carry_schema,
    )
    rows = timed.withColumn("_flag", F.lit(1)).withColumn("_rate", F.lit(None).cast("double")).unionByName(
        carry.withColumn("_flag", F.lit(0)), allowMissingColumns=True
    )
    out = T.StructType(list(df.schema) + [T.StructField("rate", T.DoubleType(), True)])
    out = T.StructType([T.StructField(f.name, f.dataType, True) for f in out])
    return _walk(
        rows, keys + ["_bucket"], ["_flag", "_t", *order],
        kernels.rate_series(keys, keep, gain, df.columns, to_arrow_schema(out)), out,
    )


def gaps(df: DataFrame, keys: list[str], ts: str, limit_seconds: float, bucket_seconds: float | None = None) -> DataFrame:
    """Pairs of neighbouring rows of a key that lie more than ``limit_seconds`` apart.

    Columns: keys, ``gap_start``, ``gap_end``, ``gap_seconds``. Gaps inside a
    bucket come from a window over (key, bucket); gaps across buckets from the
    table of bucket borders.
    """
    limit, width = _micros(limit_seconds), _width(df, keys, ts, bucket_seconds)
    timed = _timed(df.where(F.col(ts).isNotNull()), ts, width).select(*keys, "_bucket", "_t")
    inner = W.partitionBy(*keys, "_bucket").orderBy("_t")
    inside = timed.withColumn("_prev", F.lag("_t").over(inner)).select(*keys, "_prev", "_t")
    borders = timed.groupBy(*keys, "_bucket").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
    across = borders.select(
        *keys,
        F.lag("_hi").over(W.partitionBy(*keys).orderBy("_bucket")).alias("_prev"),
        F.col("_lo").alias("_t"),
    )
    return (
        inside.unionByName(across)
        .where(F.col("_t") - F.col("_prev") > limit)
        .select(
            *keys,
            F.timestamp_micros("_prev").alias("gap_start"),
            F.timestamp_micros("_t").alias("gap_end"),
            ((F.col("_t") - F.col("_prev")) / F.lit(float(MICROS))).alias("gap_seconds"),
        )
    )


def sessions(
    df: DataFrame, keys: list[str], ts: str, idle_seconds: float, bucket_seconds: float | None = None
) -> DataFrame:
    """Runs of a key's rows whose neighbours are at most ``idle_seconds`` apart.

    Rows become partial sessions per (key, bucket) first; only those, at most one
    per idle gap and bucket, are merged per key.
    Columns: keys, ``session_start``, ``session_end``, ``rows``, ``session_no``.
    """
    idle, width = _micros(idle_seconds), _width(df, keys, ts, bucket_seconds)
    timed = _timed(df.where(F.col(ts).isNotNull()), ts, width).select(*keys, "_bucket", "_t")
    inner = W.partitionBy(*keys, "_bucket").orderBy("_t")
    opened = F.coalesce((F.col("_t") - F.lag("_t").over(inner) > idle).cast("int"), F.lit(1))
    partial = (
        timed.withColumn("_open", opened)
        .withColumn("_part", F.sum("_open").over(inner))
        .groupBy(*keys, "_bucket", "_part")
        .agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    )
    outer = W.partitionBy(*keys).orderBy("_lo")
    starts = F.coalesce((F.col("_lo") - F.lag("_hi").over(outer) > idle).cast("int"), F.lit(1))
    return (
        partial.withColumn("_open", starts)
        .withColumn("session_no", F.sum("_open").over(outer))
        .groupBy(*keys, "session_no")
        .agg(
            F.timestamp_micros(F.min("_lo")).alias("session_start"),
            F.timestamp_micros(F.max("_hi")).alias("session_end"),
            F.sum("_n").alias("rows"),
        )
    )


def previous_row(
    df: DataFrame, keys: list[str], ts: str, value: str, order: list[str], bucket_seconds: float | None = None
) -> DataFrame:
    """Append ``previous_<value>``: the value of the key's latest earlier row.

    The bucket borders supply the value for each bucket's first row.
    """
    width = _width(df, keys, ts, bucket_seconds)
    name = f"previous_{value}"
    timed = _timed(df, ts, width)
    ordering = [F.col("_t"), *[F.col(o) for o in order]]
    last = F.struct("_t", *order)
    borders = timed.groupBy(*keys, "_bucket").agg(F.max_by(F.col(value), last).alias("_v"))
    carried = borders.select(
        *keys, "_bucket", F.lag("_v").over(W.partitionBy(*keys).orderBy("_bucket")).alias("_carried")
    )
    # The carried value rides along as one extra row per bucket, sorted first.
    extra = carried.select(*keys, "_bucket", F.col("_carried").alias(value), F.lit(0).alias("_flag"))
    rows = timed.withColumn("_flag", F.lit(1)).unionByName(extra, allowMissingColumns=True)
    inner = W.partitionBy(*keys, "_bucket").orderBy("_flag", *ordering)
    return (
        rows.withColumn(name, F.lag(value).over(inner))
        .where("_flag = 1")
        .select(*df.columns, name)
    )
