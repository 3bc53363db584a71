"""Helpers that keep groups of any size spread over tasks.

One key may hold a third of all rows.  Counts, minima and ``min_by`` combine before the
shuffle and need no care; lists, ranks and neighbours within a group do, and go through
the functions here.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut, side

# Documents per numbering bucket.
BUCKET_DOCS = 256


def null_safe(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    """Equality of column pairs in which null equals null (still a hash or merge join)."""
    return reduce(lambda a, b: a & b, [left[x].eqNullSafe(right[y]) for x, y in pairs])


def allocate_ids(rows: DataFrame, existing: DataFrame, pos: str = "pos") -> DataFrame:
    """Number new rows from ``max(existing.id) + 1`` in document order.

    ``pos`` is a struct whose first field is the document number.  Counts per bucket of
    documents give each bucket its start, and rows are ranked inside their bucket only, so
    the result does not depend on partitioning and no task sees more than one bucket.  The
    running sum sees one row per bucket.
    """
    bucketed = rows.withColumn("_bucket", F.floor(F.col(f"{pos}.doc") / BUCKET_DOCS))
    sizes = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    top = F.coalesce(existing.agg(F.max("id")).scalar(), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(pos))
    # Ranked first, rows lie by bucket, so merging moves none; left alone, either side may be sent to all tasks.
    return (
        bucketed.withColumn("_rank", rank).join(starts.hint("merge"), "_bucket")
        .withColumn("id", (top + F.col("_start") + F.col("_rank")).cast("bigint"))
        .drop("_bucket", "_start", "_rank")
    )


def allocate_ranges(rows: DataFrame, counts: dict[str, DataFrame], pos: str = "pos") -> DataFrame:
    """Number the items of rows in document order, as ``allocate_ids`` would number the items
    themselves, without moving them.

    Each count column of ``counts`` is numbered from the largest id of its table; it is replaced by
    ``<column>_start``, the id before the row's first item.
    """
    bucketed = rows.withColumn("_bucket", F.floor(F.col(f"{pos}.doc") / BUCKET_DOCS))
    sizes = bucketed.groupBy("_bucket").agg(*[F.sum(c).alias(f"_n_{c}") for c in counts])
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_bucket", *[F.coalesce(F.sum(f"_n_{c}").over(before), F.lit(0)).alias(f"_s_{c}") for c in counts])
    above = Window.partitionBy("_bucket").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    for c in counts:
        bucketed = bucketed.withColumn(f"_r_{c}", F.coalesce(F.sum(c).over(above), F.lit(0)))
    out = bucketed.join(starts.hint("merge"), "_bucket")
    for c, existing in counts.items():
        top = F.coalesce(existing.agg(F.max("id")).scalar(), F.lit(0))
        out = out.withColumn(f"{c}_start", (top + F.col(f"_s_{c}") + F.col(f"_r_{c}")).cast("bigint"))
    return out.drop("_bucket", *[x for c in counts for x in (c, f"_s_{c}", f"_r_{c}")])


def change_runs(
    rows: DataFrame, keys: Sequence[str], value: str, pos: str = "pos", last: str | None = None
) -> DataFrame:
    """Add ``run``: 1, 2, ... over stretches of equal ``value`` in document order per key, and
    in ``last``, if named, the number of the key's last one.

    Nulls are equal to each other.  Ranks run inside (key, bucket of documents); the
    buckets of a key are then chained by their first and last value, so a hot key is cut
    into many small windows.
    """
    # One column for key and bucket, in which nulls are equal, so joining moves no ranked row.
    inner = Window.partitionBy("_key").orderBy(pos)
    bucket = F.floor(F.col(f"{pos}.doc") / BUCKET_DOCS).alias("_bucket")
    marked = (
        rows.withColumn("_key", F.struct(*keys, bucket))
        .withColumn("_seen", F.row_number().over(inner) > 1)
        .withColumn("_prev", F.lag(value).over(inner))
        .withColumn(
            "_step",
            (F.col("_seen") & ~F.col(value).eqNullSafe(F.col("_prev"))).cast("bigint"),
        )
    )
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = marked.withColumn("_inner", F.sum("_step").over(upto))
    # One row per (key, bucket): how many changes it holds and what it begins and ends with.
    # They are as many as the keys, so they are merged, whatever the size of the files says.
    chain = Window.partitionBy(*[f"_key.{k}" for k in keys]).orderBy("_key._bucket")
    ends = marked.groupBy("_key").agg(
        F.sum("_step").alias("_steps"),
        F.min_by(F.struct(F.col(value).alias("v")), pos).alias("_first"),
        F.max_by(F.struct(F.col(value).alias("v")), pos).alias("_last"),
    )
    ends = (
        ends.withColumn("_before", F.lag("_last").over(chain))
        .withColumn(
            "_enter",
            F.when(F.col("_before").isNull(), F.lit(1))
            .otherwise((~F.col("_first.v").eqNullSafe(F.col("_before.v"))).cast("bigint"))
            .cast("bigint"),
        )
        .withColumn(
            "_base",
            F.sum("_enter").over(chain.rowsBetween(Window.unboundedPreceding, 0))
            + F.coalesce(
                F.sum("_steps").over(chain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .withColumn("_end", F.max(F.col("_base") + F.col("_steps")).over(Window.partitionBy(*[f"_key.{k}" for k in keys])))
        .select(F.col("_key").alias("_k_key"), "_base", "_end")
        .hint("merge")
    )
    out = marked.join(ends, F.col("_key") == F.col("_k_key")).withColumn("run", F.col("_base") + F.col("_inner"))
    out = out if last is None else out.withColumn(last, F.col("_end"))
    return out.drop("_key", "_k_key", "_seen", "_prev", "_step", "_inner", "_base", "_end")


def previous_value(
    rows: DataFrame, keys: Sequence[str], value: str, pos: str = "pos"
) -> DataFrame:
    """Add ``previous``: struct(v) of the row before in document order per key, null for the
    first row.  Windows are cut into buckets of documents as in ``change_runs``."""
    inner = Window.partitionBy(*keys, "_bucket").orderBy(pos)
    boxed = F.struct(F.col(value).alias("v"))
    marked = rows.withColumn("_bucket", F.floor(F.col(f"{pos}.doc") / BUCKET_DOCS)).withColumn(
        "_prev", F.lag(boxed).over(inner)
    )
    chain = Window.partitionBy(*keys).orderBy("_bucket")
    ends = (
        marked.groupBy(*keys, "_bucket").agg(F.max_by(boxed, pos).alias("_last"))
        .withColumn("_before", F.lag("_last").over(chain))
        .select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_k_bucket"), "_before")
        .hint("merge")
    )
    pairs = [(k, f"_k_{k}") for k in keys] + [("_bucket", "_k_bucket")]
    return (
        marked.join(ends, null_safe(marked, ends, pairs))
        .withColumn("previous", F.coalesce("_prev", "_before"))
        .drop("_bucket", "_prev", "_before", *[y for _, y in pairs])
    )


def number_documents(docs: DataFrame, order: str, keep_order: bool = True) -> DataFrame:
    """Add ``doc``: 0, 1, ... in the order of the unique column ``order``, which the result has
    too unless told otherwise.

    Documents are moved once: range partitions are sorted and written with each row's place, so
    a recomputed partition cannot change the numbering.  The running sum sees one row per
    partition, and so does the table that is sent to all tasks.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    kept = [c for c in docs.columns if keep_order or c != order]
    ranged = docs.repartitionByRange(order).sortWithinPartitions(order)
    fixed = cut(ranged.select(*kept, F.spark_partition_id().alias("_slice"), place.alias("_place")), "documents")
    sizes = fixed.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(sizes.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")), "starts")
    return (
        fixed.join(F.broadcast(starts), "_slice")
        .withColumn("doc", F.col("_start") + F.col("_place"))
        .drop("_slice", "_start", "_place")
    )


def replace_rows(table: DataFrame, changed: DataFrame, key: str = "id") -> DataFrame:
    """``table`` with the rows of ``changed`` in place of those of equal key."""
    kept = table.join(side(changed.select(key)), key, "left_anti")
    return kept.select(table.columns).unionByName(changed.select(table.columns))


def _keys(ids: DataFrame, id_col: str, name: str) -> DataFrame:
    """The ids to test against.  Foreign keys repeat and are made distinct (combined before
    the shuffle), so that a hot one is not a hot partition; primary keys are so already."""
    keys = ids.select(F.col(id_col).alias(name))
    return keys if id_col == "id" else keys.distinct()


def without_ids(table: DataFrame, ids: DataFrame, col: str = "id", id_col: str = "id") -> DataFrame:
    """Rows of ``table`` whose ``col`` is not among ``ids``; null never matches."""
    gone = _keys(ids, id_col, "_gone")
    return table.join(gone, table[col] == gone["_gone"], "left_anti")


def only_ids(table: DataFrame, ids: DataFrame, col: str = "id", id_col: str = "id") -> DataFrame:
    """Rows of ``table`` whose ``col`` is among ``ids``."""
    wanted = _keys(ids, id_col, "_wanted")
    return table.join(wanted, table[col] == wanted["_wanted"], "left_semi")


def remap_column(table: DataFrame, mapping: DataFrame, col: str) -> DataFrame:
    """Replace ``col`` by ``mapping(old_id -> new_id)``; other values stay."""
    m = mapping.select(F.col("old_id").alias("_old"), F.col("new_id").alias("_new"))
    joined = table.join(m, table[col] == m["_old"], "left")
    kept = [
        F.coalesce(F.col("_new"), F.col(c)).alias(c) if c == col else F.col(c)
        for c in table.columns
    ]
    return joined.select(*kept)


def remap_links(link: DataFrame, mapping: DataFrame, col: str) -> DataFrame:
    """Re-point a link column to the kept id, each resulting pair once.

    A link whose kept pair already exists simply folds into it.
    """
    return remap_column(link, mapping, col).dropDuplicates(link.columns)


def add_links(link: DataFrame, new: DataFrame) -> DataFrame:
    """Append pairs that are not linked yet."""
    return link.unionByName(new.select(link.columns)).dropDuplicates(link.columns)


def new_links(link: DataFrame, new: DataFrame) -> DataFrame:
    """The pairs of ``new`` that ``link`` lacks, each once."""
    return new.select(link.columns).distinct().join(link.hint("merge"), link.columns, "left_anti")


def repeat_rows(rows: DataFrame, times: str, chunk: int = 10_000) -> DataFrame:
    """Each row ``times`` times.  Large counts are first cut into chunks, which are shuffled
    apart, so neither an array nor a task grows with one row's count.

    The number of partitions is given: adaptive execution would join partitions by the size of the
    chunks, which says nothing of the rows they stand for."""
    chunks = rows.withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col(times) - 1) / chunk).cast("int")))
    )
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = chunks.repartition(parts, *[c for c in chunks.columns])
    left = F.least(F.lit(chunk), F.col(times) - F.col("_chunk") * chunk).cast("int")
    return spread.withColumn("_copy", F.explode(F.sequence(F.lit(1), left))).drop("_chunk", "_copy", times)
