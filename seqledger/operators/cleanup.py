"""Bulk clean-up jobs: duplicates, key re-mapping, orphans, uri hosts.

Every function takes the tables and returns the changed ones; nothing is updated in place.
Keepers come from minima (combined before the shuffle) joined back to the rows, never from
ranks within a group, so a group of any size stays spread over tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bytes_md5, is_topup, topup_base, topup_number, topup_type, union_alias
from ..schemas import RUN_PROCESSING, TRANSFER
from ..session import cut, side
from .entities import Tables
from .grouping import (
    add_links,
    null_safe,
    only_ids,
    remap_column,
    remap_links,
    repeat_rows,
    without_ids,
)


def keeper_mapping(rows: DataFrame, keys: list[str], prefer: Column | None = None) -> DataFrame:
    """(old_id, new_id, keys...) for every row of a group of more than one.

    The keeper has the least ``prefer``, then the lowest id.  Nulls form one group.
    """
    order = F.struct(F.col("id")) if prefer is None else F.struct(prefer.alias("p"), F.col("id"))
    groups = duplicate_groups(rows, keys, order).select(
        *[F.col(k).alias(f"_g_{k}") for k in keys], "keep_id"
    )
    joined = rows.join(groups, null_safe(rows, groups, [(k, f"_g_{k}") for k in keys]))
    return joined.select(F.col("id").alias("old_id"), F.col("keep_id").alias("new_id"), *keys)


def duplicate_groups(rows: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """(keys..., keep_id, cnt) of groups of more than one row."""
    order = F.struct(F.col("id")) if order is None else order
    return (
        rows.groupBy(*keys)
        .agg(F.min(order)["id"].alias("keep_id"), F.count(F.lit(1)).alias("cnt"))
        .filter(F.col("cnt") > 1)
    )


def removed(mapping: DataFrame) -> DataFrame:
    """Ids of a mapping that give way to another one."""
    return mapping.filter(F.col("old_id") != F.col("new_id")).select(F.col("old_id").alias("id"))


# --- duplicate metrics per readset ---------------------------------------------------------


def _linked_metrics(t: Tables) -> DataFrame:
    m = t["metric"].select(F.col("id").alias("metric_id"), "name", "value")
    return t["readset_metric"].join(m, "metric_id")


def duplicate_metrics(t: Tables) -> DataFrame:
    """(readset_id, name, value, cnt, keep_metric_id) of metrics a readset holds repeatedly."""
    return (
        _linked_metrics(t)
        .groupBy("readset_id", "name", "value")
        .agg(F.count(F.lit(1)).alias("cnt"), F.min("metric_id").alias("keep_metric_id"))
        .filter(F.col("cnt") > 1)
    )


def redundant_metrics(t: Tables) -> DataFrame:
    """Ids of the metrics that are not the kept one in some group; null values never match."""
    return (
        _linked_metrics(t)
        .join(duplicate_metrics(t), ["readset_id", "name", "value"])
        .filter(F.col("metric_id") != F.col("keep_metric_id"))
        .select("metric_id")
        .distinct()
    )


def prune_metric_links(t: Tables) -> DataFrame:
    """Metric links without the redundant metrics, whichever readset they belong to."""
    return without_ids(t["readset_metric"], redundant_metrics(t), "metric_id", "metric_id")


def relink_pairs(t: Tables, groups: DataFrame, links: DataFrame) -> DataFrame:
    """(job_id, keep_metric_id, copies): jobs of a readset, once per other metric it holds.

    The number of other metrics is counted per readset and per group instead of joining
    every link with every group.
    """
    held = links.groupBy("readset_id").agg(F.count(F.lit(1)).alias("held"))
    own = (
        links.join(
            groups.select("readset_id", F.col("keep_metric_id").alias("metric_id")),
            ["readset_id", "metric_id"],
            "left_semi",
        )
        .groupBy("readset_id", "metric_id")
        .agg(F.count(F.lit(1)).alias("own"))
        .withColumnRenamed("metric_id", "keep_metric_id")
    )
    others = (
        groups.join(held, "readset_id")
        .join(own, ["readset_id", "keep_metric_id"], "left")
        .withColumn("copies", F.col("held") - F.coalesce("own", F.lit(0)))
        .filter(F.col("copies") > 0)
    )
    # Readsets without a group drop out before jobs are looked up.
    jobs = t["readset_job"].join(groups.select("readset_id").distinct(), "readset_id", "left_semi").join(
        t["job"].select(F.col("id").alias("job_id")), "job_id", "left_semi")
    return others.join(jobs, "readset_id").select("job_id", "keep_metric_id", "copies")


def relink_jobs_to_kept(t: Tables) -> DataFrame:
    """New metric rows (without id): the kept metric copied for the jobs of its readset.

    One copy per job and per *other* metric the readset still holds after the pruning, as a
    multiset; running it again appends again.
    """
    groups = cut(duplicate_metrics(t), "duplicate-metrics")
    pairs = relink_pairs(t, groups, prune_metric_links(t))
    kept = t["metric"].drop("job_id").withColumnRenamed("id", "keep_metric_id")
    cols = [c for c in t["metric"].columns if c != "id"]
    # Copies are made last, so that none of them is moved to a join.
    return repeat_rows(pairs.join(kept, "keep_metric_id"), "copies").select("keep_metric_id", *cols)


# --- operation configs ----------------------------------------------------------------------


def config_mapping(t: Tables) -> DataFrame:
    """(old_id, new_id, md5sum): configs of equal bytes go to the lowest id; all null-data
    configs together form one group."""
    hashed = t["operation_config"].select("id", bytes_md5(F.col("data")).alias("md5sum"))
    keep = hashed.groupBy(F.col("md5sum").alias("_md5")).agg(F.min("id").alias("new_id"))
    return hashed.join(keep, hashed["md5sum"].eqNullSafe(keep["_md5"])).select(
        F.col("id").alias("old_id"), "new_id", "md5sum"
    )


def consolidate_configs(t: Tables) -> Tables:
    """Operations on the kept configs, and the kept configs alone."""
    mapping = config_mapping(t)
    return {
        "operation": remap_column(t["operation"], mapping, "operation_config_id"),
        "operation_config": only_ids(t["operation_config"], mapping, "id", "new_id"),
    }


# --- repeated extractions of one sample -----------------------------------------------------


def topup_names(samples: DataFrame) -> DataFrame:
    """(id, name, base, num, type) of samples named ``base-<num><type>``."""
    name = F.col("name")
    return samples.filter(is_topup(name)).select(
        "id", "name", topup_base(name).alias("base"), topup_number(name).alias("num"),
        topup_type(name).alias("type"),
    )


def topup_keepers(samples: DataFrame) -> DataFrame:
    """(base, type, id_keep, name_keep, num_keep): lowest number per group, then lowest id."""
    return (
        topup_names(samples)
        .groupBy("base", "type")
        .agg(F.min(F.struct("num", "id", "name")).alias("k"))
        .select(
            "base", "type", F.col("k.id").alias("id_keep"), F.col("k.name").alias("name_keep"),
            F.col("k.num").alias("num_keep"),
        )
    )


def topup_pairs(samples: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """(id_keep, name_keep, id_remove, name_remove).

    Samples of a higher number go to their group's keeper; ``manual`` adds pairs by name
    (columns ``keep_name``, ``remove_name``).
    """
    named = topup_names(samples)
    auto = (
        named.join(topup_keepers(samples), ["base", "type"])
        .filter(F.col("num") > F.col("num_keep"))
        .select("id_keep", "name_keep", F.col("id").alias("id_remove"), F.col("name").alias("name_remove"))
    )
    if manual is None:
        return auto
    keep = samples.select(F.col("id").alias("id_keep"), F.col("name").alias("name_keep"))
    gone = samples.select(F.col("id").alias("id_remove"), F.col("name").alias("name_remove"))
    by_name = (
        manual.join(keep, manual["keep_name"] == keep["name_keep"])
        .join(gone, F.col("remove_name") == gone["name_remove"])
        .select("id_keep", "name_keep", "id_remove", "name_remove")
    )
    return auto.unionByName(by_name)


def merge_topups(t: Tables, pairs: DataFrame) -> Tables:
    """Samples merged into their keepers: names kept as aliases, readsets re-pointed.

    The alias list is one column of the keeper's row and holds distinct names only.  A sample given away to several keepers goes to the lowest one.
    """
    pairs = cut(pairs, "topup-pairs")
    aliases = pairs.groupBy(F.col("id_keep").alias("_keep")).agg(
        F.array_sort(F.collect_set("name_remove")).alias("_added")
    )
    sample = t["sample"]
    named = sample.join(aliases, sample["id"] == aliases["_keep"], "left").select(
        *[
            F.when(F.col("_keep").isNotNull(), union_alias(F.col("alias"), F.col("_added")))
            .otherwise(F.col("alias")).alias("alias")
            if c == "alias" else F.col(c)
            for c in sample.columns
        ]
    )
    mapping = pairs.groupBy(F.col("id_remove").alias("old_id")).agg(F.min("id_keep").alias("new_id"))
    return {
        "sample": without_ids(named, pairs, "id", "id_remove"),
        "readset": remap_column(t["readset"], mapping, "sample_id"),
    }


# --- uri hosts ------------------------------------------------------------------------------


def consolidate_uri(t: Tables, hosts: dict[str, str]) -> DataFrame:
    """Locations with long host names shortened; of equal uris the lowest id stays.

    ``hosts`` maps long to short names; they are handled one after the other.
    """
    location = t["location"]
    for long, short in hosts.items():
        uri = F.col("uri")
        is_long = uri.startswith(long)
        touched = location.filter(is_long | uri.startswith(short))
        renamed = touched.withColumn("_uri", F.replace(uri, F.lit(long), F.lit(short)))
        keep = renamed.groupBy("_uri").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("cnt"))
        repeated = keep.filter(F.col("cnt") > 1).select("_uri", F.col("id").alias("_keep"))
        gone = renamed.join(repeated, "_uri").filter(F.col("id") != F.col("_keep")).select("id")
        location = without_ids(location, gone)
        for c in ("endpoint", "uri"):
            # Both columns are decided by the uri as it was read.
            location = location.withColumn(
                f"_{c}", F.when(is_long, F.replace(F.col(c), F.lit(long), F.lit(short))).otherwise(F.col(c))
            )
        location = location.select(
            *[F.col(f"_{c}").alias(c) if c in ("endpoint", "uri") else F.col(c) for c in t["location"].columns]
        )
    return location


# --- duplicate files ------------------------------------------------------------------------


def duplicate_files(t: Tables) -> DataFrame:
    """(name, md5sum, keep_file_id, cnt): deliverable first, then lowest id."""
    order = F.struct((~F.col("deliverable")).alias("p"), F.col("id"))
    return duplicate_groups(t["file"], ["name", "md5sum"], order).withColumnRenamed(
        "keep_id", "keep_file_id"
    )


def duplicate_file_mapping(t: Tables) -> DataFrame:
    """(old_id, new_id) of every file of a duplicate group, the keeper included."""
    return keeper_mapping(t["file"], ["name", "md5sum"], ~F.col("deliverable")).select("old_id", "new_id")


def drop_unreferenced(t: Tables, ids: DataFrame) -> DataFrame:
    """Files without those of ``ids`` that no readset and no job links to any more."""
    free = without_ids(without_ids(ids, t["readset_file"], "id", "file_id"), t["job_file"], "id", "file_id")
    return without_ids(t["file"], free)


def deduplicate_files(t: Tables) -> Tables:
    """Files of equal name and md5 merged: links and locations go to the keeper."""
    mapping = cut(duplicate_file_mapping(t), "file-mapping")
    out = dict(t)
    out["readset_file"] = remap_links(t["readset_file"], mapping, "file_id")
    out["job_file"] = remap_links(t["job_file"], mapping, "file_id")
    out["location"] = remap_column(t["location"], mapping, "file_id")
    # Links now name keepers only, so every other file of a group is free.
    out["file"] = drop_unreferenced(out, removed(mapping))
    return {k: out[k] for k in ("readset_file", "job_file", "location", "file")}


# --- files without location -----------------------------------------------------------------


def unlocated_files(t: Tables) -> DataFrame:
    return without_ids(t["file"], t["location"], "id", "file_id")


def missing_location_count(t: Tables) -> DataFrame:
    return unlocated_files(t).agg(F.count(F.lit(1)).alias("files"))


def _placed(t: Tables, files: DataFrame) -> DataFrame:
    """(file_id, name, operation_id, job_id) of files with their jobs."""
    f = files.select(F.col("id").alias("file_id"), "name")
    j = t["job"].select(F.col("id").alias("job_id"), "operation_id")
    return t["job_file"].join(f, "file_id").join(j, "job_id").select(
        "file_id", "name", "operation_id", "job_id"
    )


def _located(t: Tables) -> DataFrame:
    return _placed(t, only_ids(t["file"], t["location"], "id", "file_id"))


def _all_placed(t: Tables) -> DataFrame:
    """(file_id, name, operation_id, job_id, located, named) of all files with their jobs; ``named``
    files have a uri that ends with their name."""
    f = t["file"].select(F.col("id").alias("file_id"), "name")
    spots = (
        t["location"].select("file_id", "uri").join(f, "file_id")
        .groupBy(F.col("file_id").alias("_spot"))
        .agg(F.coalesce(F.max(F.col("uri").endswith(F.col("name"))), F.lit(False)).alias("named"))
    )
    f = f.join(spots, F.col("file_id") == F.col("_spot"), "left").withColumn("located", F.col("_spot").isNotNull())
    j = t["job"].select(F.col("id").alias("job_id"), "operation_id")
    return t["job_file"].join(f, "file_id").join(j, "job_id").select(
        "file_id", "name", "operation_id", "job_id", "located", "named"
    )


# Numbers come first, as sorts are quick by them and slow by names that begin alike.
STRICT = ["job_id", "operation_id", "name"]


def strict_candidates(placed: DataFrame) -> DataFrame:
    """Unlocated files that share name and job with a located one."""
    twins = placed.filter("located").select(*STRICT).distinct()
    return placed.filter("not located").select("file_id", *STRICT).join(twins, STRICT, "left_semi")


def strict_pairs(t: Tables, candidates: DataFrame, located: DataFrame) -> DataFrame:
    """(readset_id, remove_file_id, keep_file_id)."""
    keep = located.select(F.col("file_id").alias("keep_file_id"), *STRICT)
    # Which files stand in for a file is settled before readsets come in.
    twins = candidates.join(keep, STRICT).select("file_id", "keep_file_id").distinct()
    return (
        t["readset_file"].join(twins, "file_id")
        .select("readset_id", F.col("file_id").alias("remove_file_id"), "keep_file_id")
        .distinct()
    )


def _drop_files(t: Tables, ids: DataFrame, col: str = "file_id") -> Tables:
    return {
        "readset_file": without_ids(t["readset_file"], ids, "file_id", col),
        "job_file": without_ids(t["job_file"], ids, "file_id", col),
        "file": without_ids(t["file"], ids, "id", col),
    }


def rescue_strict(t: Tables) -> Tables:
    """Readset links moved from unlocated files to their located twins of the same job; the
    unlocated files and their links are dropped."""
    placed = cut(_all_placed(t), "placed")
    candidates = cut(strict_candidates(placed), "strict")
    linked = strict_pairs(t, candidates, placed.filter("located")).select("readset_id", F.col("keep_file_id").alias("file_id"))
    return _drop_files({**t, "readset_file": add_links(t["readset_file"], linked)}, candidates)


def job_only_files(t: Tables) -> DataFrame:
    """Unlocated files that jobs link to but no readset does."""
    bare = without_ids(unlocated_files(t), t["readset_file"], "id", "file_id")
    return only_ids(bare, t["job_file"], "id", "file_id").select(F.col("id").alias("file_id"))


def drop_job_only(t: Tables) -> Tables:
    gone = cut(job_only_files(t), "job-only")
    out = _drop_files(t, gone)
    return {k: out[k] for k in ("job_file", "file")}


def _untwinned(t: Tables, located: DataFrame) -> DataFrame:
    """Unlocated files with their jobs, where no located file shares name and job."""
    twins = located.select(*STRICT).distinct()
    return _placed(t, unlocated_files(t)).join(twins, STRICT, "left_anti")


def unlocated_readset_files(t: Tables) -> DataFrame:
    """(file_id, name, readset_id, operation_id, job_id) without a strict twin."""
    return _untwinned(t, _located(t)).join(t["readset_file"], "file_id").select(
        "file_id", "name", "readset_id", "operation_id", "job_id"
    )


def _rescuers(t: Tables, located: DataFrame, keys: list[str]) -> DataFrame:
    """(located_file_id, keys...): located files with a uri that ends with their name."""
    ends = (
        t["location"].select("file_id", "uri")
        .join(t["file"].select(F.col("id").alias("file_id"), F.col("name").alias("_name")), "file_id")
        .filter(F.col("uri").endswith(F.col("_name")))
        .select("file_id").distinct()
    )
    found = located.join(ends, "file_id", "left_semi")
    return found.select(F.col("file_id").alias("located_file_id"), *keys).distinct()


LOOSE = ["operation_id", "name"]


def rescue_candidates(t: Tables, loose: bool = True) -> DataFrame:
    """(remove_file_id, name, readset_id, located_file_id): located files of the same
    operation and name whose uri ends with the name, each once.

    ``loose`` allows any job; strict wants the same job and is empty by construction, since
    files with such a twin were set aside before.
    """
    keys = LOOSE if loose else STRICT
    located = cut(_located(t), "located")
    # Jobs and operations drop out before readsets come in.
    wanted = _untwinned(t, located).select("file_id", *keys).distinct()
    pairs = wanted.join(_rescuers(t, located, keys), keys).select("file_id", "name", "located_file_id").distinct()
    return t["readset_file"].join(pairs, "file_id").select(
        F.col("file_id").alias("remove_file_id"), "name", "readset_id", "located_file_id"
    )


def rescue_loose(t: Tables) -> Tables:
    """Links moved to every located file found by name and operation; rescued files dropped.

    Links to add and links to drop are worked out apart, so removed and located files of a
    name never meet pair by pair.
    """
    placed = cut(_all_placed(t), "placed")
    twins = placed.filter("located").select(*STRICT).distinct()
    wanted = cut(
        placed.filter("not located").join(twins, STRICT, "left_anti").select("file_id", *LOOSE).distinct(), "wanted"
    )
    # A name and operation goes by a number from here on; once written, the numbers stay.
    groups = cut(wanted.select(*LOOSE).distinct().withColumn("_group", F.monotonically_increasing_id()), "rescue-groups")
    groups = side(groups)
    rescuers = cut(
        placed.filter("named").join(groups, LOOSE).select(F.col("file_id").alias("located_file_id"), "_group").distinct(),
        "rescuers",
    )
    rescued = cut(
        wanted.join(groups, LOOSE).select("file_id", "_group")
        .join(rescuers.select("_group").distinct(), "_group", "left_semi"),
        "rescued",
    )
    old = cut(t["readset_file"].join(side(rescued), "file_id").select("readset_id", "file_id", "_group"), "old-links")
    # A file no readset links to is not part of the rescue.
    gone = cut(old.select("file_id").distinct(), "gone")
    moved = (
        old.select("readset_id", "_group").distinct()
        .join(side(rescuers), "_group").select("readset_id", F.col("located_file_id").alias("file_id"))
    )
    # Rescued files are unlocated, so no added link can point at one of them.
    out = _drop_files(t, gone)
    out["readset_file"] = add_links(out["readset_file"], moved)
    return out


# --- orphans --------------------------------------------------------------------------------


def orphan_jobs(t: Tables) -> DataFrame:
    return without_ids(
        without_ids(t["job"], t["readset_job"], "id", "job_id"), t["job_file"], "id", "job_id"
    ).select("id")


def orphan_metrics(t: Tables, deletable: bool) -> DataFrame:
    """Metrics of orphan jobs: those no readset links to, or those one still does."""
    m = only_ids(t["metric"].select("id", "job_id"), orphan_jobs(t), "job_id")
    pick = without_ids if deletable else only_ids
    return pick(m, t["readset_metric"], "id", "metric_id").select("id")


def drop_orphan_jobs(t: Tables) -> Tables:
    """Unlinked metrics of orphan jobs dropped, then the orphan jobs left without metrics."""
    orphans = cut(orphan_jobs(t), "orphan-jobs")
    m = t["metric"].select("id", "job_id")
    gone = cut(
        without_ids(only_ids(m, orphans, "job_id"), t["readset_metric"], "id", "metric_id").select("id"),
        "orphan-metrics",
    )
    metric = without_ids(t["metric"], gone)
    return {
        "metric": metric,
        "job": without_ids(t["job"], without_ids(orphans, metric, "id", "job_id")),
    }


def orphan_operations(t: Tables) -> DataFrame:
    return without_ids(
        without_ids(t["operation"], t["readset_operation"], "id", "operation_id"),
        t["job"], "id", "operation_id",
    ).select("id")


def drop_orphan_operations(t: Tables) -> DataFrame:
    return without_ids(t["operation"], orphan_operations(t))


# --- duplicate operations, jobs, metrics ----------------------------------------------------

OPERATION_KEY = ["name", "cmd_line", "platform", "operation_config_id"]
JOB_KEY = ["operation_id", "name", "start", "stop"]
METRIC_KEY = ["job_id", "name", "value"]


def operation_mapping(t: Tables) -> DataFrame:
    rows = t["operation"].filter(F.col("name").isin(RUN_PROCESSING, TRANSFER))
    return keeper_mapping(rows, OPERATION_KEY).select("old_id", "new_id")


def dedup_operations(t: Tables) -> Tables:
    """Run-processing and transfer operations of equal attributes merged into the lowest id.

    Links fold into the kept operation's; none of the kept one's own links is lost.
    """
    mapping = cut(operation_mapping(t), "operation-mapping")
    return {
        "readset_operation": remap_links(t["readset_operation"], mapping, "operation_id"),
        "job": remap_column(t["job"], mapping, "operation_id"),
        "operation": without_ids(t["operation"], removed(mapping)),
    }


def duplicate_jobs(t: Tables) -> DataFrame:
    return duplicate_groups(t["job"], JOB_KEY)


def dedup_jobs(t: Tables) -> Tables:
    mapping = cut(keeper_mapping(t["job"], JOB_KEY).select("old_id", "new_id"), "job-mapping")
    return {
        "readset_job": remap_links(t["readset_job"], mapping, "job_id"),
        "job_file": remap_links(t["job_file"], mapping, "job_id"),
        "metric": remap_column(t["metric"], mapping, "job_id"),
        "job": without_ids(t["job"], removed(mapping)),
    }


def duplicate_job_metrics(t: Tables) -> DataFrame:
    return duplicate_groups(t["metric"], METRIC_KEY)


def dedup_metrics(t: Tables) -> Tables:
    mapping = cut(keeper_mapping(t["metric"], METRIC_KEY).select("old_id", "new_id"), "metric-mapping")
    return {
        "readset_metric": remap_links(t["readset_metric"], mapping, "metric_id"),
        "metric": without_ids(t["metric"], removed(mapping)),
    }


# --- the whole clean-up and its report ------------------------------------------------------

CLEANUP_STEPS = (
    ("rescue_strict", rescue_strict),
    ("drop_job_only", drop_job_only),
    ("rescue_loose", rescue_loose),
    ("drop_orphan_jobs", drop_orphan_jobs),
    ("drop_orphan_operations", lambda t: {"operation": drop_orphan_operations(t)}),
    ("dedup_operations", dedup_operations),
    ("dedup_jobs", dedup_jobs),
    ("dedup_metrics", dedup_metrics),
)
# Tables that several steps read.
CLEANUP_SHARED = ("job", "job_file", "location", "metric", "readset_file", "readset_job", "readset_metric", "readset_operation")


def cleanup_all(t: Tables) -> tuple[Tables, DataFrame]:
    """All orphan and duplicate steps in order, each on the result of the one before; and
    the report.  Changed tables are written between steps, which ends their lineage; those that
    several steps read are written before the first."""
    t = {**t, **{k: cut(t[k], k) for k in CLEANUP_SHARED}}
    reports = []
    for name, step in CLEANUP_STEPS:
        changed = {k: cut(v, f"{name}-{k}") for k, v in step(t).items()}
        reports.append(cleanup_report(name, {k: t[k] for k in changed}, changed))
        t = {**t, **changed}
    return t, reduce(DataFrame.unionByName, reports)


def cleanup_report(step: str, before: Tables, after: Tables) -> DataFrame:
    """(step, table, rows_before, rows_after, rows_deleted, rows_remapped) per table.

    Deleted and remapped count rows by id for entities; links count as pairs that are gone
    and pairs that are new.
    """
    return reduce(
        DataFrame.unionByName,
        [_table_report(step, name, before[name], after[name]) for name in sorted(after)],
    )


def _table_report(step: str, name: str, before: DataFrame, after: DataFrame) -> DataFrame:
    is_entity = "id" in before.columns
    keys = ["id"] if is_entity else before.columns
    # A link is all key, so there is nothing else to compare.
    content = F.md5(F.to_json(F.struct(*before.columns))) if is_entity else F.lit("")
    b = before.select(*keys, content.alias("_b"))
    a = after.select(*[F.col(k).alias(f"_a_{k}") for k in keys], content.alias("_a"))
    both = b.join(a, null_safe(b, a, [(k, f"_a_{k}") for k in keys]), "full")
    changed = (F.col("_b") != F.col("_a")) if is_entity else F.col("_b").isNull()
    return both.agg(
        F.count("_b").alias("rows_before"),
        F.count("_a").alias("rows_after"),
        F.count_if(F.col("_a").isNull()).alias("rows_deleted"),
        F.count_if(changed).alias("rows_remapped"),
    ).select(F.lit(step).alias("step"), F.lit(name).alias("table"), "*")
