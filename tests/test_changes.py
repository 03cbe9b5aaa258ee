"""Stored matches after gallery changes, and keyed tables with partial rewrites."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import match, registry
from sightline.operators.refresh import refresh_topk, rematch_open
from sightline.operators.similarity import similarity_topk
from sightline.params import MatchParams
from sightline.session import scratch_path
from sightline.sources.versioned import KeyedTable


def vectors(spark, n, seed, start=0, d=6):
    rng = np.random.default_rng(seed)
    m = np.round(rng.normal(size=(n, d)))  # whole numbers, so that equal similarities occur
    m[m.any(1) == 0] = 1.0
    m[: n // 3] = m[0]  # a third of all rows alike
    return spark.createDataFrame([(start + i, f"e{i % 5}", v.tolist()) for i, v in enumerate(m)] + [(start + n, "none", None)], "id long, entity_id string, embedding array<double>")


def listed(df):
    return sorted((r["id"], r["rank"], r["match_id"], r["match_label"], round(r["similarity"], 9)) for r in df.collect())


@pytest.mark.parametrize("case,k", [("both", 1), ("best_removed", 1), ("both", 4), ("none", 4), ("all_removed", 4), ("best_removed", 4)])
def test_refresh_equals_new_search(spark, k, case):
    queries, old, new = vectors(spark, 30, 1), vectors(spark, 80, 2, 1000), vectors(spark, 25, 3, 5000)
    found = similarity_topk(queries, old, "id", "id", k, 0.2)
    added = new if case == "both" else new.limit(0)
    gone = {
        "both": old.where("id % 3 = 0"), "none": old.limit(0), "all_removed": old,
        "best_removed": found.where("rank = 1").select(F.col("match_id").alias("id")),
    }[case].select("id")
    gallery = old.join(gone, "id", "left_anti").unionByName(added)
    still = queries.where("id % 4 > 0")
    got = refresh_topk(found, still, gallery, added, gone, "id", "id", k, 0.2)
    assert listed(got) == listed(similarity_topk(still, gallery, "id", "id", k, 0.2))


def test_changed_rows_and_decisions(spark):
    """A relabelled row and one with a new vector stand in both tables; a chain of changes stays right."""
    p = MatchParams(accept=0.6, floor=0.3, single_shot_min=0.6)
    probes, gallery = vectors(spark, 20, 4), vectors(spark, 60, 5, 1000)
    found = similarity_topk(probes, gallery, "id", "id", 3, p.floor)
    for step in range(2):
        changed = gallery.where(f"id % 7 = {step}").withColumn("entity_id", F.lit(f"new{step}")).withColumn("embedding", F.reverse("embedding"))
        gallery = gallery.join(changed.select("id"), "id", "left_anti").unionByName(changed)
        decisions, found = rematch_open(found, probes, gallery, changed, changed, "id", "id", p, 3)
        want = match.match_entities(probes, gallery, "id", "id", p)
        assert sorted(map(tuple, decisions.collect())) == sorted(map(tuple, want.collect()))


def people(spark, n):
    return spark.range(n).selectExpr("concat('P', id) AS entity_id", "concat('n', id) AS name", "1 AS gallery_version")


def test_ten_keys_rewrite_their_partitions_only(spark):
    table = KeyedTable(scratch_path(spark, "keyed"), "entity_id")
    assert table.version(spark) is None
    assert table.create(people(spark, 2000), 64) == 1
    changes = spark.range(1996, 2006).selectExpr("concat('P', id) AS entity_id", "'new' AS name")
    assert table.rewrite(changes, lambda old: registry.upsert_entities(old, changes)) == 2
    held = table.holders(spark)
    assert 1 <= sum(at == 2 for at in held.values()) <= 10 and len(held) == 64
    want = registry.upsert_entities(people(spark, 2000), changes)
    assert sorted(table.read(spark).collect()) == sorted(want.collect())
    assert sorted(table.read(spark, 1).collect()) == sorted(people(spark, 2000).collect())
    assert sorted(r["name"] for r in table.lookup(changes).collect()) == ["new"] * 10
    # A delete that empties partitions, then no keys at all.
    assert table.rewrite(people(spark, 2006), lambda old: old.where("name = 'new'")) == 3
    assert table.read(spark).count() == 10
    assert table.rewrite(people(spark, 0), lambda old: old) == 3


def test_a_writer_that_dies_leaves_the_old_version(spark):
    table = KeyedTable(scratch_path(spark, "keyed"), "entity_id")
    table.create(people(spark, 100), 4)
    before = sorted(table.read(spark).collect())

    with pytest.raises(Exception, match="outside its partitions"):
        table.rewrite(people(spark, 1), lambda old: old.unionByName(people(spark, 100)))
    assert table.version(spark) == 1 and sorted(table.read(spark).collect()) == before
    # The next writer is not held up; one that starts from a version that is no longer the newest fails.
    assert table.rewrite(people(spark, 1), lambda old: old.where("entity_id <> 'P0'")) == 2
    assert table.read(spark).count() == 99 and sorted(table.read(spark, 1).collect()) == before

    def overtaken(old):
        table.rewrite(people(spark, 2), lambda rows: rows.where("entity_id <> 'P1'"))
        return old

    with pytest.raises(RuntimeError, match="taken"):
        table.rewrite(people(spark, 1), overtaken)
    assert table.version(spark) == 3 and table.read(spark).count() == 98
    with pytest.raises(ValueError, match="adds or drops"):
        table.rewrite(people(spark, 1), lambda old: old.drop("name"))


def test_null_keys_repeats_empty_and_hot_keys(spark):
    rows = people(spark, 30).unionByName(people(spark, 30)).unionByName(people(spark, 2).withColumn("entity_id", F.lit(None).cast("string")))
    hot = spark.range(500).selectExpr("'hot' AS entity_id", "concat('h', id) AS name", "2 AS gallery_version")
    table = KeyedTable(scratch_path(spark, "keyed"), "entity_id")
    table.create(rows.unionByName(hot), 8)
    assert sorted(table.read(spark).fillna("-").collect()) == sorted(rows.unionByName(hot).fillna("-").collect())
    table.rewrite(hot.limit(1), lambda old: old.where("entity_id IS NULL OR entity_id <> 'hot'"))
    assert table.read(spark).count() == 62
    empty = KeyedTable(scratch_path(spark, "keyed"), "entity_id")
    empty.create(people(spark, 0))
    assert empty.read(spark).count() == 0
    empty.rewrite(people(spark, 5), lambda old: old.unionByName(people(spark, 5)))
    assert empty.read(spark).count() == 5
    assert os.path.basename(empty.root).startswith("sightline-keyed")
