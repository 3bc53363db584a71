"""Filtered entity queries.

All return whole rows of one table, each row once: related tables only restrict it, through
semi joins.  The flag filter looks at the returned table alone, never at its parents.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grouping import only_ids

Tables = dict[str, DataFrame]
Ids = int | Iterable[int] | None


def _list(ids: Ids) -> list[int]:
    if ids is None:
        return []
    return [ids] if isinstance(ids, int) else list(ids)


def _flags(df: DataFrame, deprecated: bool, deleted: bool) -> DataFrame:
    return df.filter((F.col("deprecated") == deprecated) & (F.col("deleted") == deleted))


def _in(df: DataFrame, col: str, ids: Ids) -> DataFrame:
    wanted = _list(ids)
    return df.filter(F.col(col).isin(wanted)) if wanted else df


def _specimens_of(t: Tables, project_id: Ids) -> DataFrame:
    """Specimens of existing projects."""
    inside = t["specimen"].filter(F.col("project_id").isin(_list(project_id)))
    return only_ids(inside, t["project"], "project_id")


def readsets_within(
    t: Tables,
    project_id: Ids,
    specimen_id: Ids = None,
    sample_id: Ids = None,
    readset_id: Ids = None,
) -> DataFrame:
    """Readsets of a project; the first id filter given applies, the others do not."""
    specimen = _specimens_of(t, project_id)
    sample, readset = t["sample"], t["readset"]
    if specimen_id:
        specimen = _in(specimen, "id", specimen_id)
    elif sample_id:
        sample = _in(sample, "id", sample_id)
    elif readset_id:
        readset = _in(readset, "id", readset_id)
    return only_ids(readset, only_ids(sample, specimen, "specimen_id"), "sample_id")


def projects(
    t: Tables, project_id: Ids = None, deprecated: bool = False, deleted: bool = False
) -> DataFrame:
    return _flags(_in(t["project"], "id", project_id), deprecated, deleted)


def _linked(
    t: Tables, entity: str, project_id: Ids, own: Ids, specimen_id: Ids, sample_id: Ids,
    readset_id: Ids, deprecated: bool, deleted: bool,
) -> DataFrame:
    """Files or metrics reached through readset, sample and specimen."""
    rows = _flags(t[entity], deprecated, deleted)
    if own:
        rows = _in(rows, "id", own)
        reach = readsets_within(t, project_id)
    else:
        reach = readsets_within(t, project_id, specimen_id, sample_id, readset_id)
    links = only_ids(t[f"readset_{entity}"], reach, "readset_id")
    return only_ids(rows, links, "id", f"{entity}_id")


def metrics(
    t: Tables, project_id: Ids, deliverable: bool | None = None, specimen_id: Ids = None,
    sample_id: Ids = None, readset_id: Ids = None, metric_id: Ids = None,
    deprecated: bool = False, deleted: bool = False,
) -> DataFrame:
    rows = _linked(
        t, "metric", project_id, metric_id, specimen_id, sample_id, readset_id, deprecated, deleted
    )
    return rows if deliverable is None else rows.filter(F.col("deliverable") == deliverable)


def files(
    t: Tables, project_id: Ids, deliverable: bool | None = None, specimen_id: Ids = None,
    sample_id: Ids = None, readset_id: Ids = None, file_id: Ids = None,
    state: str | None = None, deprecated: bool = False, deleted: bool = False,
) -> DataFrame:
    rows = _linked(
        t, "file", project_id, file_id, specimen_id, sample_id, readset_id, deprecated, deleted
    )
    if deliverable is not None:
        rows = rows.filter(F.col("deliverable") == deliverable)
    return rows if state is None else rows.filter(F.col("state") == state)


def operations(
    t: Tables, project_id: Ids, operation_id: Ids = None, readset_id: Ids = None,
    deprecated: bool = False, deleted: bool = False,
) -> DataFrame:
    rows = _flags(t["operation"], deprecated, deleted).filter(
        F.col("project_id").isin(_list(project_id))
    )
    rows = only_ids(rows, t["project"], "project_id")
    if operation_id:
        return _in(rows, "id", operation_id)
    if readset_id:
        links = only_ids(
            _in(t["readset_operation"], "readset_id", readset_id), t["readset"], "readset_id"
        )
        return only_ids(rows, links, "id", "operation_id")
    return rows


def jobs(
    t: Tables, project_id: Ids, job_id: Ids = None, readset_id: Ids = None,
    deprecated: bool = False, deleted: bool = False,
) -> DataFrame:
    inside = t["operation"].filter(F.col("project_id").isin(_list(project_id)))
    inside = only_ids(inside, t["project"], "project_id")
    rows = only_ids(_flags(t["job"], deprecated, deleted), inside, "operation_id")
    if job_id:
        return _in(rows, "id", job_id)
    if readset_id:
        links = only_ids(
            _in(t["readset_job"], "readset_id", readset_id), t["readset"], "readset_id"
        )
        return only_ids(rows, links, "id", "job_id")
    return rows


def readsets(
    t: Tables, project_id: Ids, specimen_id: Ids = None, sample_id: Ids = None,
    readset_id: Ids = None, deprecated: bool = False, deleted: bool = False,
) -> DataFrame:
    return _flags(
        readsets_within(t, project_id, specimen_id, sample_id, readset_id), deprecated, deleted
    )


def specimens(
    t: Tables, project_id: Ids, specimen_id: Ids = None, sample_id: Ids = None,
    readset_id: Ids = None, deprecated: bool = False, deleted: bool = False,
) -> DataFrame:
    rows = _flags(_specimens_of(t, project_id), deprecated, deleted)
    if specimen_id:
        return _in(rows, "id", specimen_id)
    if sample_id:
        return only_ids(rows, _in(t["sample"], "id", sample_id), "id", "specimen_id")
    if readset_id:
        owners = only_ids(t["sample"], _in(t["readset"], "id", readset_id), "id", "sample_id")
        return only_ids(rows, owners, "id", "specimen_id")
    return rows


def samples(
    t: Tables, project_id: Ids, specimen_id: Ids = None, sample_id: Ids = None,
    readset_id: Ids = None, tumour: bool | None = None,
    deprecated: bool = False, deleted: bool = False,
) -> DataFrame:
    rows = _flags(t["sample"], deprecated, deleted)
    if tumour is not None:
        rows = rows.filter(F.col("tumour") == tumour)
    specimen = _specimens_of(t, project_id)
    if specimen_id:
        specimen = _in(specimen, "id", specimen_id)
    elif sample_id:
        rows = _in(rows, "id", sample_id)
    elif readset_id:
        rows = only_ids(rows, _in(t["readset"], "id", readset_id), "id", "sample_id")
    return only_ids(rows, specimen, "specimen_id")


def samples_pair(
    t: Tables, project_id: Ids, pair: bool = True, specimen_id: Ids = None,
    deprecated: bool = False, deleted: bool = False,
) -> DataFrame:
    """Samples with at least one DNA readset.  ``pair`` has no effect on the rows."""
    dna = t["experiment"].filter(F.col("nucleic_acid_type") == "DNA")
    rows = only_ids(
        _flags(t["sample"], deprecated, deleted),
        only_ids(t["readset"], dna, "experiment_id"),
        "id",
        "sample_id",
    )
    return only_ids(rows, _in(_specimens_of(t, project_id), "id", specimen_id), "specimen_id")


def name_to_id(t: Tables, table: str, names: str | Iterable[str]) -> DataFrame:
    """Ids of the rows with any of these names, whatever their flags.

    If one name starts with ``r:`` all become unanchored patterns, plain ones literally.
    """
    wanted = [names] if isinstance(names, str) else list(names)
    if any(n.startswith("r:") for n in wanted):
        patterns = [n[2:] if n.startswith("r:") else re.escape(n) for n in wanted]
        hit = reduce(lambda a, b: a | b, [F.col("name").rlike(p) for p in patterns])
    else:
        hit = F.col("name").isin(wanted)
    return t[table].filter(hit).select("id")


def names_found(t: Tables, table: str, names: DataFrame) -> DataFrame:
    """Exact lookup of a table of names (column ``name``): the ids that match."""
    return t[table].join(names.select("name").distinct(), "name", "left_semi").select("id")


# Which related names a query takes, strongest first, and how each reaches the entity.
NAME_FILTERS: dict[str, tuple[str, ...]] = {
    "specimen": ("specimen", "sample", "readset"),
    "sample": ("specimen", "sample", "readset"),
    "readset": ("specimen", "sample", "readset"),
    "operation": ("operation", "readset"),
    "job": ("job", "readset"),
    "file": ("file", "specimen", "sample", "readset"),
    "metric": ("metric", "specimen", "sample", "readset"),
}

QUERIES: dict[str, Callable[..., DataFrame]] = {
    "specimen": specimens,
    "sample": samples,
    "readset": readsets,
    "operation": operations,
    "job": jobs,
    "file": files,
    "metric": metrics,
}


def query_by_names(
    t: Tables, entity: str, project_id: Ids, by: dict[str, str | Iterable[str]], **filters
) -> DataFrame:
    """Rows of ``entity`` selected by the names of one related entity.

    Names resolve over the whole table, then the id filter of that entity applies: the
    strongest field of ``by`` counts.  The looked-up ids stay a table, never a driver list.
    """
    field = next(f for f in NAME_FILTERS[entity] if by.get(f))
    ids = name_to_id(t, field, by[field])
    narrowed = dict(t)
    if field == entity:
        return only_ids(QUERIES[entity](t, project_id, **filters), ids)
    narrowed[field] = only_ids(t[field], ids)
    if entity == "specimen":
        sample = only_ids(t["sample"], narrowed["readset"], "id", "sample_id") \
            if field == "readset" else narrowed["sample"]
        return only_ids(specimens(t, project_id, **filters), sample, "id", "specimen_id")
    if entity == "sample" and field == "readset":
        return only_ids(samples(t, project_id, **filters), narrowed["readset"], "id", "sample_id")
    if entity in ("operation", "job"):
        links = only_ids(t[f"readset_{entity}"], narrowed["readset"], "readset_id")
        return only_ids(QUERIES[entity](t, project_id, **filters), links, "id", f"{entity}_id")
    return QUERIES[entity](narrowed, project_id, **filters)


def no_match(rows: DataFrame, entity: str, **criteria) -> DataFrame:
    """One warning row naming the criteria when ``rows`` is empty, else none."""
    detail = ", ".join(f"{k}={v}" for k, v in criteria.items())
    counted = rows.limit(1).agg(F.count(F.lit(1)).alias("_n"))
    return counted.filter("_n = 0").select(
        F.lit("no_match").alias("code"),
        F.lit(entity).alias("entity"),
        F.lit(None).cast("bigint").alias("entity_id"),
        F.lit(detail).alias("detail"),
    )
