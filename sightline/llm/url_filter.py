"""URL filters: allow and block rules, else gradient-boosted trees on lexical features.

Everything is made of DataFrame functions and the JVM's own tree learner. Features: lengths,
depth, shares of digits and marks, entropy of the whole URL, parameters, and how often the
labelled URLs of the same host suffix, and those of the same first path segment, are bad. The
trees learn from a bounded sample of labelled URLs. Where no other labels are given,
rule_labels() takes the rules' own verdicts: the trees then carry over to all other URLs
what the rules say about theirs.

Defined cases: a null URL or one without "://" has an empty host and path and is judged by
the trees; repeated rows get equal verdicts; without labelled URLs of both kinds every URL
that no rule fits gets the verdict of the only kind there is, or else "allow".
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import checkpointed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class TreeSpec:
    """Trees, their depth, the least URLs of a leaf, and the most labelled URLs that they learn from."""

    trees: int = 10
    depth: int = 3
    leaf: int = 20
    sample: int = 20_000
    seed: int = 11


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        on, _, under = rule.partition("/")
        fits = ((host == on) | host.endswith("." + on)) & path.startswith("/" + under)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _share(text: Column, pattern: str) -> Column:
    kept = F.length(F.regexp_replace(text, pattern, ""))
    return F.when(F.length(text) > 0, 1 - kept / F.length(text)).otherwise(0.0)


def entropy(text: Column) -> Column:
    """Bits per character: the sorted characters are walked once, run by run."""
    letters = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    n = F.size(letters).cast("double")

    def bits(run: Column) -> Column:
        return F.when(run > 0, run * F.log2(run)).otherwise(0.0)

    def step(state: Column, c: Column) -> Column:
        same = c == state["last"]
        return F.struct(
            c.alias("last"), F.when(same, state["run"] + 1.0).otherwise(F.lit(1.0)).alias("run"),
            F.when(same, state["total"]).otherwise(state["total"] + bits(state["run"])).alias("total"),
        )

    start = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("total"))
    total = F.aggregate(letters, start, step, lambda state: state["total"] + bits(state["run"]))
    return F.when(n > 0, F.log2(n) - total / n).otherwise(0.0)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def segment_of(path: Column) -> Column:
    """The first path segment that more follows, or nothing."""
    return F.regexp_extract(path, "^/([^/]*)/", 1)


RATED = ("suffix", "segment")
FEATURES = (
    "n_url", "n_host", "n_path", "depth", "digits", "marks", "bits", "params", "labels", "suffix_rate", "suffix_known", "segment_rate", "segment_known",
)


def with_features(urls: DataFrame) -> DataFrame:
    """Lexical features of (url, host, path)."""
    text = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    return urls.select(
        "*", F.length(text).cast("double").alias("n_url"), F.length("host").cast("double").alias("n_host"), F.length("path").cast("double").alias("n_path"),
        F.size(F.filter(F.split("path", "/"), lambda p: p != "")).cast("double").alias("depth"), _share(text, "[0-9]").alias("digits"),
        _share(text, "[^A-Za-z0-9]").alias("marks"), entropy(text).alias("bits"),
        F.size(F.filter(F.split(query, "&"), lambda p: p != "")).cast("double").alias("params"),
        F.size(F.split("host", r"\.")).cast("double").alias("labels"), suffix_of(F.col("host")).alias("suffix"),
        segment_of(F.col("path")).alias("segment"),
    )


def with_parts(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    return urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))


def by_rule(rule: Column, rules: dict[str, str]) -> Column:
    """The verdict of a rule, or null."""
    return F.coalesce(*[F.when(rule == k, F.lit(v)) for k, v in rules.items()], F.lit(None).cast("string"))


def rule_labels(pages: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, bad) of the URLs that a rule fits: 1.0 where it blocks."""
    urls = with_parts(pages, id_col, url_col)
    verdict = by_rule(best_rule(F.col("host"), F.col("path"), rules), rules)
    return urls.select(F.col("page_id").alias("id"), (verdict == "block").cast("double").alias("bad")).where("bad IS NOT NULL")


def labelled_sample(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", spec: TreeSpec | None = None) -> DataFrame:
    """At most ``sample`` labelled URLs, by hash, with their features and label."""
    spec = spec or TreeSpec()
    known = labels.where("id IS NOT NULL AND bad IS NOT NULL").groupBy("id").agg(F.avg("bad").alias("_bad"))
    urls = with_parts(pages, id_col, url_col)
    labelled = urls.join(known, F.col("page_id") == F.col("id")).select("page_id", "url", "host", "path", (F.col("_bad") >= 0.5).cast("double").alias("label"))
    hashed = labelled.withColumn("_h", F.xxhash64("page_id", "url"))
    bound = hashed.select("_h").orderBy("_h").limit(spec.sample).agg(F.max("_h")).first()[0]
    picked = hashed.where(F.col("_h") <= F.lit(bound)).dropDuplicates(["_h"]).drop("_h")
    return checkpointed(with_features(picked))


class Trees:
    """Boosted trees and the suffix and segment statistics of the sample they learned from."""

    def __init__(self, sample: DataFrame, spec: TreeSpec):
        bad, n = sample.agg(F.sum("label"), F.count("*")).first()
        self.base = bad / n
        # At most one row per sampled URL.
        self.rates = [checkpointed(sample.groupBy(c).agg(F.count("*").cast("double").alias("n"), F.sum("label").alias("bad"))) for c in RATED]
        learner = GBTClassifier(maxIter=spec.trees, maxDepth=spec.depth, minInstancesPerNode=spec.leaf, seed=spec.seed, labelCol="label")
        self.model = learner.fit(self._vectors(sample).select("features", "label").coalesce(4))

    def _vectors(self, frame: DataFrame) -> DataFrame:
        for name, counts in zip(RATED, self.rates, strict=True):
            rate = (F.col("bad") + 10 * self.base) / (F.col("n") + 10)
            frame = frame.join(F.broadcast(counts.select(name, F.log1p("n").alias(f"{name}_known"), rate.alias(f"{name}_rate"))), name, "left")
            frame = frame.fillna({f"{name}_known": 0.0, f"{name}_rate": self.base})
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(frame)

    def scored(self, urls: DataFrame) -> DataFrame:
        """``urls`` with the trees' ``prediction``."""
        return self.model.transform(self._vectors(urls))


def held_out_accuracy(sample: DataFrame, spec: TreeSpec | None = None) -> tuple[float, float]:
    """Shares of held-out URLs (a fifth of the sample, by hash) that the trees, and the best constant verdict, get right."""
    part = F.pmod(F.xxhash64("url"), F.lit(5))
    trees = Trees(sample.where(part != 0), spec or TreeSpec())
    right, bad = trees.scored(sample.where(part == 0)).agg(F.avg((F.col("prediction") == F.col("label")).cast("double")), F.avg("label")).first()
    return right, max(bad, 1 - bad)


def judged(
    pages: DataFrame, labels: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url", spec: TreeSpec | None = None
) -> DataFrame:
    """One row per row of ``pages``: host, path, the fitting rule, verdict, and whether the trees would block.

    ``labels`` is (id, bad): 1 for a URL to block. A null or repeated label is ignored or averaged.
    """
    spec = spec or TreeSpec()
    urls = with_parts(pages, id_col, url_col)
    sample = labelled_sample(pages, labels, id_col, url_col, spec)
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    ruled = urls.withColumn("rule", best_rule(F.col("host"), F.col("path"), rules))
    verdict = by_rule(F.col("rule"), rules)
    if len(counts) < 2:
        only = "block" if counts and next(iter(counts)) == 1.0 else "allow"
        return ruled.select("page_id", "host", "path", "rule", F.coalesce(verdict, F.lit(only)).alias("verdict"), F.lit(only == "block").alias("tree_block"))
    scored = Trees(sample, spec).scored(with_features(ruled))
    tree = F.col("prediction") == 1.0
    return scored.select(
        "page_id", "host", "path", "rule", F.coalesce(verdict, F.when(tree, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), tree.alias("tree_block")
    )
