"""Benchmark decontamination with DataFrame functions only.

Words are runs of digits, letters a-z (after lower-casing A-Z) and characters beyond ASCII.
A window is ``size`` consecutive words of a benchmark item; an item with fewer words, but
not none, is one window. The hashes of the windows' first words (at most four) form the
broadcast set; every document's words are scanned against it, and each hit is verified by
comparing the whole window's words. A benchmark with more than ``set_limit`` windows, those
of every item counted, is not broadcast: the scanned positions are then joined by a shuffle.

Defined cases: a null text has no words and no hits; an item without words has no window;
repeated rows each get their own, equal, result; items of equal text are all reported;
an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import checkpointed

# Characters that part words, and how many words the scanned hash covers at most.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ANCHOR = 4


def word_array(text: Column) -> Column:
    """Words of a text, in order; empty for null."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.filter(F.split(low, NOT_WORD), lambda w: w != "")


def _paired(a: Column, shift: int, b: Column) -> Column:
    """Hash of a[i] and b[i + shift], for every i that has both."""
    n = F.greatest(F.size(b) - shift, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(shift + 1), n), lambda x, y: F.xxhash64(x, y))


def grams(words: Column, n: int) -> Column:
    """Hashes of all runs of n words, n from 1 to 4."""
    one = F.transform(words, lambda w: F.xxhash64(w))
    if n == 1:
        return one
    two = _paired(one, 1, one)
    return {2: two, 3: _paired(two, 2, one), 4: _paired(two, 2, two)}[n]


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = 10) -> DataFrame:
    """(item_id, window words, length, anchor hash), one row per distinct window of an item."""
    items = benchmark.select(F.col(id_col).alias("item_id"), word_array(F.col(text_col)).alias("_w")).where(F.size("_w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - size + 1, F.lit(1)))
    cut = items.select("item_id", "_w", F.explode(starts).alias("_s")).select(
        "item_id", F.expr(f"slice(_w, _s, {size})").alias("window")
    )
    cut = cut.withColumn("length", F.size("window")).withColumn("anchor_length", F.least(F.col("length"), F.lit(ANCHOR)))
    by_length = F.coalesce(
        *[F.when(F.col("anchor_length") == n, F.element_at(grams(F.slice("window", 1, n), n), 1)) for n in range(1, ANCHOR + 1)]
    )
    return cut.withColumn("anchor", by_length).distinct()


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 10, set_limit: int = 50_000
) -> DataFrame:
    """One row per row of ``docs``: n_words, hit words, items found, and the hit ranges.

    ``ranges`` are merged word ranges [from, to), counted from 0.
    """
    windows = checkpointed(benchmark_windows(benchmark, size=size))
    sizes = [r["anchor_length"] for r in windows.select("anchor_length").distinct().collect()]
    # The broadcast table has a row per window of each item, so its rows are what is bounded.
    small = windows.count() <= set_limit
    picked = docs.select(
        F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256).alias("text_key"),
        word_array(F.col(text_col)).alias("_w"),
    )
    hits = F.array().cast("array<struct<at:int,anchor:bigint,anchor_length:int,next:array<string>>>")
    for n in sorted(sizes):
        picked = picked.withColumn(f"_g{n}", grams(F.col("_w"), n))
        known = "true"
        if small:
            rows = windows.where(F.col("anchor_length") == n).select("anchor").distinct().collect()
            known = f"h IN ({', '.join(str(r['anchor']) + 'L' for r in rows)})"
        # Most documents hold no anchor at all: for them the scan ends at exists().
        hits = F.concat(
            hits,
            F.expr(
                f"CASE WHEN exists(_g{n}, h -> {known}) THEN transform(filter(transform(_g{n}, (h, i) -> IF({known}, i + 1, NULL)), at -> at IS NOT NULL), "
                f"at -> named_struct('at', at, 'anchor', element_at(_g{n}, at), 'anchor_length', {n}, 'next', slice(_w, at, {size}))) "
                "ELSE array() END"
            ),
        )
    scanned = checkpointed(picked.select("doc_id", "text_key", F.size("_w").cast("long").alias("n_words"), hits.alias("hits")))
    at = scanned.where(F.size("hits") > 0).select("doc_id", "text_key", F.explode("hits").alias("h")).select("doc_id", "text_key", "h.*")
    held = F.broadcast(windows) if small else windows
    verified = at.join(held, ["anchor_length", "anchor"]).where(F.expr("slice(next, 1, length) = window"))
    spans = F.array_sort(F.collect_set(F.struct((F.col("at") - 1).alias("from"), (F.col("at") - 1 + F.col("length")).alias("to"))))
    per_doc = verified.groupBy("doc_id", "text_key").agg(
        spans.alias("_spans"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")
    )
    merged = F.aggregate(
        "_spans",
        F.array().cast("array<struct<from:int,to:int>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["to"] >= s["from"]),
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(F.struct(F.try_element_at(acc, F.lit(-1))["from"].alias("from"), F.greatest(F.try_element_at(acc, F.lit(-1))["to"], s["to"]).alias("to"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(s["from"].alias("from"), s["to"].alias("to"))))),
    )
    per_doc = per_doc.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), merged.alias("ranges"), "items")
    joined = scanned.select("doc_id", "text_key", "n_words").join(
        per_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left"
    )
    ranges = F.coalesce("ranges", F.array().cast("array<struct<from:int,to:int>>"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "text_key", "n_words",
        F.aggregate(ranges, F.lit(0).cast("long"), lambda n, r: n + (r["to"] - r["from"]).cast("long")).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"), items.alias("items"), ranges.alias("ranges"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 10) -> DataFrame:
    """``docs`` without the documents in which a benchmark window occurs; all columns stay."""
    found = contamination(docs, benchmark, id_col, text_col, size).where("n_hit > 0").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    key = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
    return docs.join(found, F.col(id_col).eqNullSafe(F.col("_id")) & (key == F.col("_key")), "left_anti")
