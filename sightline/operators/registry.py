"""Jobs that change the registry, the gallery and the source table.

Each returns the new content of a table as a DataFrame; a sink writes it to a
new path and the caller swaps paths, since plain files have no row updates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions.text import after_first_word, entity_image_url, first_word
from sightline.functions.vector import l2_normalize
from sightline.operators.numbering import dense_ids
from sightline.params import AUDIT_DELETE


def one_per_key(changes: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """The last change of each key: the greatest by ``order``, then by all its columns."""
    rest = [c for c in changes.columns if c != key]
    last = F.struct(*[F.col(c) for c in [*(order or []), *rest]])
    return changes.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in changes.columns]), last).alias("_c")).select("_c.*")


def upsert_entities(
    entities: DataFrame, changes: DataFrame, key: str = "entity_id", version: str = "gallery_version", order: list[str] | None = None
) -> DataFrame:
    """Apply full new rows: a known key is replaced and its version raised, a new key
    starts at version 1. Columns that ``changes`` lacks keep the old value. Of several
    changes of a key the last by ``order`` counts."""
    changes = one_per_key(changes, key, order)
    old, new = entities.alias("o"), changes.withColumn("_new", F.lit(True)).alias("n")
    joined = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    changed = F.col("n._new").isNotNull()

    def value(name: str) -> Column:
        if name == key:
            return F.coalesce(f"o.{key}", f"n.{key}")
        if name == version:
            raised = F.coalesce(f"o.{version}", F.lit(1)) + 1
            return (
                F.when(changed & F.col(f"o.{key}").isNotNull(), raised)
                .when(changed, 1)
                .otherwise(F.col(f"o.{version}"))
                .cast("int")
            )
        if name in changes.columns:
            return F.when(changed, F.col(f"n.{name}")).otherwise(F.col(f"o.{name}"))
        return F.col(f"o.{name}")

    return joined.select(*[value(c).alias(c) for c in entities.columns])


def patch_entities(entities: DataFrame, patches: DataFrame, key: str = "entity_id") -> DataFrame:
    """Partial update. A null field keeps the old value, '' clears an optional one;
    the name is rebuilt from its parts, or the parts from the name."""
    optional = [c for c in ("department", "role", "phone", "email", "notes") if c in entities.columns and c in patches.columns]
    lookup = patches.select(
        F.col(key), F.lit(True).alias("_p"), *[F.col(c).alias(f"p_{c}") for c in patches.columns if c != key]
    )
    rows = entities.join(lookup, key, "left")

    def patch(name: str) -> Column:
        return F.trim(F.coalesce(F.col(f"p_{name}"), F.lit(""))) if name in patches.columns else F.lit("")

    given = F.trim(F.concat(patch("first_name"), F.lit(" "), patch("last_name")))
    full = F.when(given != "", given).when(patch("name") != "", patch("name")).otherwise(F.col("name"))
    rows = rows.withColumn("_full", full)
    first = F.coalesce(F.nullif(patch("first_name"), F.lit("")), first_word(F.col("_full")))
    sent_last = F.col("p_last_name").isNotNull() if "last_name" in patches.columns else F.lit(False)
    old_last = F.coalesce("last_name", F.lit("")) if "last_name" in entities.columns else F.lit("")
    last = (
        F.when(sent_last, patch("last_name"))
        .when(F.instr("_full", " ") > 0, after_first_word(F.col("_full")))
        .otherwise(old_last)
    )
    new = {"name": F.col("_full"), "first_name": first, "last_name": last}
    for c in optional:
        new[c] = F.when(F.col(f"p_{c}").isNull(), F.col(c)).otherwise(F.nullif(F.col(f"p_{c}"), F.lit("")))
    return rows.select(
        *[
            F.when(F.col("_p"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c)
            for c in entities.columns
        ]
    )


def conform_schema(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Add the columns of ``schema`` that ``df`` lacks, with their default, and order
    them; extra columns stay at the end."""
    defaults = defaults or {}
    known = [
        F.col(f.name) if f.name in df.columns else F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name)
        for f in schema
    ]
    extra = [F.col(c) for c in df.columns if c not in schema.names]
    return df.select(*known, *extra)


def append_gallery(gallery: DataFrame, new: DataFrame, row_id: str, embedding: str = "embedding", gallery_id: str = "gallery_id") -> DataFrame:
    """Append unit vectors with ids that continue the gallery's; ``row_id`` orders them."""
    top = gallery.agg(F.coalesce(F.max(gallery_id), F.lit(-1))).scalar()
    unit = new.withColumn(embedding, l2_normalize(F.col(embedding).cast("array<double>")))
    numbered = dense_ids(unit, row_id, gallery_id, start=top + 1)
    return gallery.unionByName(numbered, allowMissingColumns=True)


def rebuild_gallery(gallery: DataFrame, entities: DataFrame, payloads: DataFrame, row_id: str, path: str = "image_path", gallery_id: str = "gallery_id") -> DataFrame:
    """Gallery from its rows with a payload: re-numbered from 0, unit vectors, names
    from the registry or 'Unknown'."""
    kept = gallery.where(F.nullif(F.col(path), F.lit("")).isNotNull()).join(payloads.select(path), path, "left_semi")
    names = entities.select("entity_id", F.col("name").alias("_name"))
    named = kept.join(names, "entity_id", "left").withColumn("name", F.coalesce("_name", F.lit("Unknown"))).drop("_name")
    unit = named.withColumn("embedding", l2_normalize(F.col("embedding").cast("array<double>")))
    return dense_ids(unit.drop(gallery_id), row_id, gallery_id)


def remove_entities_from_gallery(gallery: DataFrame, removed: DataFrame, row_id: str, gallery_id: str = "gallery_id") -> DataFrame:
    """Drop the entities' vectors and close the gaps in the ids."""
    rest = gallery.join(removed.select("entity_id"), "entity_id", "left_anti")
    return dense_ids(rest.drop(gallery_id), row_id, gallery_id)


def rename_in_gallery(gallery: DataFrame, entities: DataFrame) -> DataFrame:
    """Gallery rows with the registry's current names; rows of others keep theirs."""
    names = entities.select("entity_id", F.nullif(F.col("name"), F.lit("")).alias("_name"))
    return gallery.join(names, "entity_id", "left").withColumn("name", F.coalesce("_name", "name")).drop("_name")


def orphan_vectors(gallery: DataFrame, payloads: DataFrame, path: str = "image_path") -> DataFrame:
    """Gallery rows whose payload is missing."""
    return gallery.join(payloads.select(path), path, "left_anti")


def with_payload(gallery: DataFrame, payloads: DataFrame, path: str = "image_path") -> DataFrame:
    return gallery.join(payloads.select(path), path, "left_semi")


def list_payloads(spark, folder: str, path: str = "image_path") -> DataFrame:
    """Paths of the files below ``folder``, listed by Spark without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.col("path").alias(path))


def entities_without_vectors(entities: DataFrame, gallery: DataFrame) -> DataFrame:
    return entities.join(gallery.select("entity_id"), "entity_id", "left_anti")


def cascade_delete(removed: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """All tables without the removed entities' rows, and an audit row per entity."""
    ids = removed.select("entity_id").distinct()
    out = {name: df.join(ids, "entity_id", "left_anti") for name, df in tables.items()}
    out["audit"] = audit_rows(ids, AUDIT_DELETE, F.concat(F.lit("Deleted "), F.col("entity_id")))
    return out


def audit_rows(rows: DataFrame, action: str, details: Column, entity: str = "entity_id") -> DataFrame:
    """Audit records of a mutation, to be appended beside it."""
    return rows.select(F.lit(action).alias("action"), F.col(entity).alias("entity_id"), details.alias("details"))


def replace_entities(tables: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Purge the new entities' old rows from every table, then add the new rows."""
    ids = new["entities"].select("entity_id")
    out = {}
    for name, df in tables.items():
        rest = df.join(ids, "entity_id", "left_anti")
        out[name] = rest.unionByName(new[name], allowMissingColumns=True) if name in new else rest
    return out


def remove_rows(df: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(removed.select(*keys), keys, "left_anti")


def archive_previous(gallery: DataFrame, committed: DataFrame, as_of: Column) -> DataFrame:
    """Mark the active rows of re-committed entities as archived."""
    ids = committed.select("entity_id").distinct().withColumn("_c", F.lit(True))
    hit = F.coalesce(F.col("_c"), F.lit(False)) & F.col("is_active")
    return (
        gallery.join(ids, "entity_id", "left")
        .withColumn("archived_at", F.when(hit, as_of).otherwise(F.col("archived_at")))
        .withColumn("is_active", F.col("is_active") & ~hit)
        .drop("_c")
    )


def replace_in_bin(old: DataFrame, new: DataFrame, key: str, pose: str, quality: str, row_id: str, keep: int = 8) -> DataFrame:
    """Best capture per pose bin over old and new rows, the ``keep`` best bins active,
    every other row archived rather than dropped."""
    rows = old.unionByName(new, allowMissingColumns=True)
    best = diverse_captures(rows, key, pose, quality, row_id, keep).select(row_id, F.lit(True).alias("_best"))
    return rows.join(best, row_id, "left").withColumn("is_active", F.coalesce("_best", F.lit(False))).drop("_best")


def diverse_captures(captures: DataFrame, key: str, pose: str, quality: str, row_id: str, keep: int = 6) -> DataFrame:
    """Best capture per pose bin (smaller id on ties), then the ``keep`` best of a key."""
    order = F.struct(F.col(quality), -F.col(row_id))
    row = F.struct(*[c for c in captures.columns if c not in (key, pose)])
    bins = captures.groupBy(key, pose).agg(F.max_by(row, order).alias("_r")).select(key, pose, "_r.*")
    nth = F.row_number().over(W.partitionBy(key).orderBy(F.desc(quality), F.asc(row_id)))
    return bins.withColumn("position", nth.cast("long")).where(F.col("position") <= keep)


def best_capture(captures: DataFrame, key: str, quality: str, row_id: str) -> DataFrame:
    order = F.struct(F.col(quality), -F.col(row_id))
    row = F.struct(*[c for c in captures.columns if c != key])
    return captures.groupBy(key).agg(F.max_by(row, order).alias("_r")).select(key, "_r.*")


def gallery_counts(entities: DataFrame, gallery: DataFrame) -> DataFrame:
    """Registered entities with the number of their vectors (0 when none)."""
    counts = gallery.groupBy("entity_id").agg(F.count(F.lit(1)).alias("vectors"))
    return entities.join(counts, "entity_id", "left").withColumn("vectors", F.coalesce("vectors", F.lit(0)))


def entity_images(entities: DataFrame, gallery: DataFrame, row_id: str) -> DataFrame:
    """Entity rows with one row per image link, flat, so no entity's list must fit a task."""
    images = gallery.select("entity_id", row_id, entity_image_url(F.col("entity_id"), F.col("image_path")).alias("image_url"))
    return entities.join(images, "entity_id", "left")


def split_active(captures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Active captures, and the others (a null flag counts as archived)."""
    active = F.coalesce(F.col("is_active"), F.lit(False))
    return captures.where(active), captures.where(~active)


def detail_view(captures: DataFrame) -> DataFrame:
    """Capture defaults of the detail page: quality 0 or null shows 0.85."""
    return captures.withColumn(
        "quality_score", F.coalesce(F.nullif(F.col("quality_score"), F.lit(0.0)), F.lit(0.85))
    ).withColumn("pose_bin", F.coalesce(F.nullif(F.col("pose_bin"), F.lit("")), F.lit("FRONTAL"))).withColumn(
        "gallery_version", F.coalesce(F.nullif(F.col("gallery_version"), F.lit(0)), F.lit(1))
    ).withColumn("is_active", F.coalesce("is_active", F.lit(True)))


def inventory(entities: DataFrame, gallery: DataFrame) -> DataFrame:
    """Row counts, vector count, dimension and entities with vectors, as one row."""
    return gallery.agg(
        F.count(F.lit(1)).alias("total_vectors"),
        F.max(F.size("embedding")).alias("dimension"),
        F.count_distinct("entity_id").alias("entities_with_vectors"),
    ).withColumn("total_entities", entities.agg(F.count(F.lit(1))).scalar())


def inventory_sample(gallery: DataFrame, payloads: DataFrame, row_id: str, n: int = 10, path: str = "image_path") -> DataFrame:
    """The first ``n`` gallery rows and whether their payload exists."""
    first = gallery.orderBy(row_id).limit(n).select(row_id, "entity_id", path)
    return first.join(payloads.select(path, F.lit(True).alias("_e")), path, "left").select(
        row_id, "entity_id", path, F.coalesce("_e", F.lit(False)).alias("exists_on_disk")
    )


def upsert_source(sources: DataFrame, changes: DataFrame, key: str = "source_id", order: list[str] | None = None) -> DataFrame:
    """Replace or add sources; of several changes of a key the last by ``order`` counts."""
    changes = one_per_key(changes, key, order)
    return sources.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def delete_source(sources: DataFrame, removed: DataFrame, key: str = "source_id") -> DataFrame:
    return sources.join(removed.select(key), key, "left_anti")
