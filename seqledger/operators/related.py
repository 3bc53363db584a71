"""Entity rows with the ids of related entities.

A related id counts unless its entity is both deprecated and deleted.  ``related_ids`` gives
the relation in long form, one row per related id, for any number of them; ``with_related``
packs it into sorted arrays for a selection of entities that are shown one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .entities import Tables


def _seen(df: DataFrame) -> Column:
    return ~df["deprecated"] | ~df["deleted"]


def _visible(df: DataFrame, name: str) -> DataFrame:
    """(id, id or null when both flags are set)."""
    return df.select(
        F.col("id").alias(f"_{name}"), F.when(_seen(df), F.col("id")).alias(f"{name}_id")
    )


def _lineage(t: Tables) -> DataFrame:
    """Each readset with its sample and specimen; each level shows its own id or null."""
    readset = t["readset"]
    sample = t["sample"]
    s = sample.select(
        F.col("id").alias("_sample"),
        F.when(_seen(sample), F.col("id")).alias("sample_id"),
        F.col("specimen_id").alias("_specimen_fk"),
    )
    r = readset.select(
        F.col("id").alias("_readset"),
        F.when(_seen(readset), F.col("id")).alias("readset_id"),
        F.col("sample_id").alias("_sample_fk"),
    )
    p = _visible(t["specimen"], "specimen")
    return (
        r.join(s, r["_sample_fk"] == s["_sample"], "left")
        .join(p, F.col("_specimen_fk") == p["_specimen"], "left")
        .select("_readset", "readset_id", "sample_id", "specimen_id")
    )


def _via_link(t: Tables, entity: str) -> DataFrame:
    link = t[f"readset_{entity}"].select(
        F.col(f"{entity}_id").alias("id"), F.col("readset_id").alias("_fk")
    )
    seen = _visible(t["readset"], "readset")
    return link.join(seen, link["_fk"] == seen["_readset"]).select("id", "_fk", "readset_id")


def related_pairs(
    t: Tables, entity: str, kinds: tuple[str, ...] | None = None
) -> DataFrame:
    """Long form: ``id`` of the entity, ``_fk`` the related readset (or sample), and one
    nullable ``*_id`` column per related kind.  Tables no wanted kind needs are not read."""
    if entity == "specimen" and kinds == ("sample_id",):
        sample = t["sample"]
        return sample.select(
            F.col("specimen_id").alias("id"),
            F.col("id").alias("_fk"),
            F.when(_seen(sample), F.col("id")).alias("sample_id"),
        )
    if entity == "specimen":
        sample, readset = t["sample"], t["readset"]
        s = sample.select(
            F.col("specimen_id").alias("id"),
            F.col("id").alias("_sample"),
            F.when(_seen(sample), F.col("id")).alias("sample_id"),
        )
        r = readset.select(
            F.col("sample_id").alias("_sample_fk"),
            F.col("id").alias("_fk"),
            F.when(_seen(readset), F.col("id")).alias("readset_id"),
        )
        return s.join(r, s["_sample"] == r["_sample_fk"], "left").select(
            "id", F.coalesce("_fk", "_sample").alias("_fk"), "sample_id", "readset_id"
        )
    if entity == "sample":
        readset = t["readset"]
        return readset.select(
            F.col("sample_id").alias("id"),
            F.col("id").alias("_fk"),
            F.when(_seen(readset), F.col("id")).alias("readset_id"),
        )
    if entity in ("operation", "job") or kinds == ("readset_id",):
        return _via_link(t, entity)
    if entity in ("file", "metric"):
        link = t[f"readset_{entity}"].select(
            F.col(f"{entity}_id").alias("id"), F.col("readset_id").alias("_fk")
        )
        lineage = _lineage(t)
        return link.join(lineage, link["_fk"] == lineage["_readset"]).drop("_readset")
    raise ValueError(f"no related ids for {entity}")


# Kinds shown per entity, and whether hidden ids stay as nulls in the list.
RELATED = {
    "specimen": (("sample_id", "readset_id"), False),
    "sample": (("readset_id",), True),
    "operation": (("readset_id",), True),
    "job": (("readset_id",), True),
    "metric": (("readset_id", "sample_id", "specimen_id"), False),
    "file": (("readset_id", "sample_id", "specimen_id"), False),
}


def _packed(pairs: DataFrame, kind: str, keep_nulls: bool) -> Column:
    name = f"{kind}s"
    if keep_nulls:
        # collect_list drops nulls, so hidden ids travel inside a struct; nulls sort last.
        boxed = F.collect_list(F.struct(F.col(kind).isNull().alias("n"), F.col(kind).alias("v")))
        return F.transform(F.array_sort(boxed), lambda x: x["v"]).alias(name)
    return F.array_sort(F.collect_set(kind)).alias(name)


def related_ids(
    t: Tables, entity: str, kinds: tuple[str, ...] | None = None, rows: DataFrame | None = None
) -> DataFrame:
    """(id, kind, related_id) in long form, of all entities or of ``rows``.

    Each related id once per entity and kind; where the kind keeps hidden ids, each of those
    is a row with a null.  A hub is many rows, never a list.
    """
    all_kinds, keep_nulls = RELATED[entity]
    pairs = related_pairs(t, entity, kinds)
    if rows is not None:
        pairs = pairs.join(rows.select("id").distinct(), "id", "left_semi")
    each = F.explode(F.array(*[
        F.struct(F.lit(k.removesuffix("_id")).alias("kind"), F.col(k).alias("related_id")) for k in (kinds or all_kinds)
    ]))
    long = pairs.select("id", each.alias("r")).select("id", "r.kind", "r.related_id")
    return long if keep_nulls else long.filter(F.col("related_id").isNotNull()).distinct()


def with_related(
    t: Tables, entity: str, rows: DataFrame | None = None, kinds: tuple[str, ...] | None = None
) -> DataFrame:
    """Entity rows plus their arrays of related ids; entities with none get empty arrays.

    For a selection that is looked at row by row: an array is as long as the entity has
    related ids.  Bulk work takes ``related_ids``.
    """
    rows = t[entity] if rows is None else rows
    if entity == "readset":
        return with_specimen_id(t, rows)
    all_kinds, keep_nulls = RELATED[entity]
    kinds = kinds or all_kinds
    pairs = related_pairs(t, entity, kinds)
    # The whole table needs no restriction of the pairs; a selection of it does.
    if rows is not t[entity]:
        pairs = pairs.join(rows.select("id").distinct(), "id", "left_semi")
    arrays = pairs.groupBy("id").agg(*[_packed(pairs, k, keep_nulls) for k in kinds])
    empty = F.array().cast("array<bigint>")
    return rows.join(arrays, "id", "left").select(
        *rows.columns, *[F.coalesce(f"{k}s", empty).alias(f"{k}s") for k in kinds]
    )


def with_specimen_id(t: Tables, rows: DataFrame | None = None) -> DataFrame:
    """Readset rows plus ``specimen_id``, null if the specimen is deprecated and deleted."""
    rows = t["readset"] if rows is None else rows
    s = t["sample"].select(F.col("id").alias("_sample"), F.col("specimen_id").alias("_specimen_fk"))
    p = _visible(t["specimen"], "specimen")
    return (
        rows.join(s, rows["sample_id"] == s["_sample"], "left")
        .join(p, F.col("_specimen_fk") == p["_specimen"], "left")
        .select(*rows.columns, "specimen_id")
    )


def job_readset_links(t: Tables) -> DataFrame:
    """All readsets linked to each job, without looking at flags: (id, readset_id)."""
    link = t["readset_job"]
    r = t["readset"].select(F.col("id").alias("_readset"))
    return link.join(r, link["readset_id"] == r["_readset"], "left_semi").select(
        F.col("job_id").alias("id"), "readset_id"
    )


def serialize(rows: DataFrame, tablename: str) -> DataFrame:
    """All columns plus the table's name; bytes become UTF-8 text."""
    cols = [
        F.decode(F.col(f.name), "UTF-8").alias(f.name)
        if f.dataType.typeName() == "binary"
        else F.col(f.name)
        for f in rows.schema.fields
    ]
    return rows.select(*cols, F.lit(tablename).alias("tablename"))


def serialize_json(rows: DataFrame, tablename: str) -> DataFrame:
    """One JSON text per row, nulls written out."""
    full = serialize(rows, tablename)
    text = F.to_json(F.struct(*full.columns), {"ignoreNullFields": "false"})
    return full.select("id", text.alias("json"))
