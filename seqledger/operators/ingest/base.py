"""Pieces all four loaders share.

A batch of documents is loaded at once.  ``pos`` is a struct (doc, a, b, c, d): the number
of the document and the place within it; it decides what comes first.  Rows are matched and
created per natural key, nulls equal to each other, among unflagged rows unless stated.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions import before_triple_slash, union_alias, upper_name
from ...schemas import LINK_SCHEMAS, ROW_DEFAULTS, SCHEMAS
from ...session import cut, is_few, side
from ..entities import Tables
from ..grouping import allocate_ids, new_links, number_documents, replace_rows, without_ids
from ..validate import error_rows

PROJECT_KEY = ("name",)
EXPERIMENT_KEY = (
    "sequencing_technology", "type", "nucleic_acid_type", "library_kit", "kit_expiration_date",
)
RUN_KEY = ("ext_id", "ext_src", "name", "instrument", "date")
OPERATION_KEY = (
    "operation_config_id", "reference_id", "project_id", "platform", "cmd_line", "name", "status",
)
CONFIG_KEY = ("name", "version", "md5sum", "data")
JOB_KEY = ("operation_id", "name", "start", "stop", "status", "type")


# A fixed time: text, datetime or column.
Moment = str | datetime | Column


def moment(as_of: Moment) -> Column:
    """The time that stands in for the clock."""
    return (as_of if isinstance(as_of, Column) else F.lit(as_of)).cast("timestamp")


@dataclass
class Loaded:
    """What a batch of documents adds and changes."""

    inserts: Tables = field(default_factory=dict)
    updates: Tables = field(default_factory=dict)
    warnings: list[DataFrame] = field(default_factory=list)
    errors: DataFrame | None = None
    docs: DataFrame | None = None

    def tables(self, t: Tables) -> Tables:
        """``t`` with the batch applied."""
        out = dict(t)
        for name, changed in self.updates.items():
            out[name] = replace_rows(out[name], changed)
        for name, new in self.inserts.items():
            out[name] = out[name].unionByName(new.select(out[name].columns))
        return out

    def warning_rows(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.warnings)


def place(doc: str = "doc", *cols: str) -> Column:
    """The ``pos`` struct: document number and up to four positions inside it."""
    named = [F.col(c).cast("int") for c in cols] + [F.lit(0)] * (4 - len(cols))
    return F.struct(
        F.col(doc).alias("doc"), *[c.alias(n) for c, n in zip(named, "abcd", strict=True)]
    )


def number(docs: DataFrame) -> DataFrame:
    """Add ``doc``: documents in the order of their source, several of one source by content."""
    return number_documents(_ordered(docs), "_order", keep_order=False)


def _ordered(docs: DataFrame) -> DataFrame:
    """Documents with ``_order``.  They are parsed once, as finding their ranges reads them first;
    contents are looked at only where a source has several."""
    docs = cut(docs, "read")
    if docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return docs.withColumn("_order", F.col("source"))
    content = F.unhex(F.md5(F.to_json(F.struct(*[c for c in docs.columns if c != "source"]))))
    return docs.withColumn("_order", F.struct("source", content))


def numbered(t: Tables, envelopes: DataFrame, project: str | None) -> DataFrame:
    """The documents of a batch with ``doc`` and ``project_id``, written once.

    Projects are found by upper-cased name; a document gets a row for each unflagged one that
    has it (``nth`` counts them from 0), and one with nulls where none has.
    """
    names = F.upper(F.col("project_name")) if project is None else F.lit(project.upper())
    known = active(t["project"]).groupBy(F.col("name").alias("_name")).agg(F.collect_list(F.struct("id")).alias("_owners"))
    owned = _ordered(envelopes).withColumn("_key", names).join(known, F.col("_key") == F.col("_name"), "left").drop("_key", "_name")
    docs = number_documents(owned, "_order", keep_order=False)
    return docs.select("*", F.posexplode_outer("_owners").alias("nth", "_owner")).withColumn("project_id", F.col("_owner.id")).drop("_owners", "_owner")


def once(docs: DataFrame) -> DataFrame:
    """Each document once, however many projects have its name."""
    return docs.filter(F.coalesce("nth", F.lit(0)) == 0)


def readable(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents that could be read, and an error row for each of the others.

    An unreadable document is not looked into any further: it has no other error.
    """
    if "unreadable" not in docs.columns:
        docs = docs.withColumn("unreadable", F.lit(None).cast("string"))
    text = F.col("unreadable")
    detail = F.when(text == "", "no content").otherwise(F.concat_ws(" ", F.md5(text), F.substring(text, 1, 80)))
    refused = error_rows(docs.filter(text.isNotNull()), "unreadable", "document", detail)
    return docs.filter(text.isNull()).drop("unreadable"), refused


def active(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("deprecated") & ~F.col("deleted"))


def complete(rows: DataFrame, table: str, as_of: Column) -> DataFrame:
    """Rows with every column of the table: given ones, defaults, or null."""
    defaults = {
        "deprecated": F.lit(False), "deleted": F.lit(False), "creation": as_of,
        **{k: F.lit(v) for k, v in ROW_DEFAULTS.get(table, {}).items()},
    }
    cols = []
    for f in SCHEMAS[table].fields:
        given = f.name in rows.columns
        default = defaults.get(f.name, F.lit(None))
        if given and f.name in ROW_DEFAULTS.get(table, {}):
            value = F.coalesce(F.col(f.name), default)
        else:
            value = F.col(f.name) if given else default
        cols.append(value.cast(f.dataType).alias(f.name))
    return rows.select(*cols)


def warn(rows: DataFrame, code: str, entity: str, entity_id: str, detail: str) -> DataFrame:
    return rows.select(
        F.col("pos.doc").alias("doc"), F.lit(code).alias("code"), F.lit(entity).alias("entity"),
        F.col(entity_id).cast("bigint").alias("entity_id"), F.col(detail).cast("string").alias("detail"),
    )


def beside(errors: DataFrame):
    """A function that leaves out the rows of documents with errors; where these are many, what
    is left is written, so that each level of the documents is compared with them once."""
    if is_few(errors):
        bad = F.broadcast(errors.select("doc"))
        return lambda rows, label: without_ids(rows, bad, "doc", "doc")
    bad = cut(errors.select("doc").distinct(), "refused-docs").hint("merge")
    return lambda rows, label: cut(without_ids(rows, bad, "doc", "doc"), label)


@dataclass
class Resolved:
    rows: DataFrame      # incoming rows plus <table>_id, is_new, first (creates the row) and made
    new: DataFrame       # new table rows, complete
    repeats: DataFrame   # incoming rows that met an existing row

    def found(self) -> DataFrame:
        return self.rows.drop("is_new", "first", "made")


def get_or_create(
    existing: DataFrame, incoming: DataFrame, table: str, key: Sequence[str], as_of: Column,
    extra: Sequence[str] = (), any_flags: bool = False, every: bool = True,
) -> Resolved:
    """Match incoming rows on ``key``, else insert one row per key.

    The first occurrence of a key gives the new row its ``extra`` columns, which all rows of the key
    get as ``made``.  Of several stored matches the lowest id counts.  Without ``every`` only the rows
    of keys are returned that are stored already or come more than once.
    """
    # The key is one column, in which nulls are equal: grouped by it, neither side moves again.
    firsts = incoming.groupBy(F.struct(*key).alias("_key")).agg(
        F.min("pos").alias("pos"), F.count(F.lit(1)).alias("_n"), *[F.min_by(F.col(c), F.col("pos")).alias(c) for c in extra]
    )
    stored = existing if any_flags else active(existing)
    stored = stored.groupBy(F.struct(*[F.col(k).cast(incoming.schema[k].dataType).alias(k) for k in key]).alias("_s_key")).agg(F.min("id").alias("_found"))
    matched = firsts.join(side(stored, existing), F.col("_key") == F.col("_s_key"), "left")
    # Written first, as new keys are counted and then numbered.
    matched = cut(matched.select(*[F.col(f"_key.{k}").alias(k) for k in key], *extra, "pos", "_n", "_found"), f"keys-{table}")
    kept = [*key, *extra, "pos", "_n"]
    fresh = allocate_ids(matched.filter(F.col("_found").isNull()).select(*kept), existing)
    known = matched.filter(F.col("_found").isNotNull()).select(*kept, F.col("_found").alias("id"))
    plan = cut(
        known.withColumn("is_new", F.lit(False)).unionByName(fresh.withColumn("is_new", F.lit(True))),
        f"match-{table}",
    )
    met = plan if every else plan.filter(~F.col("is_new") | (F.col("_n") > 1))
    mapping = met.select(
        F.struct(*key).alias("_m_key"), F.col("id").alias(f"{table}_id"), "is_new",
        F.col("pos").alias("_first"), F.struct(F.lit(True).alias("_"), *extra).alias("made"),
    )
    few = is_few(mapping)
    if table in key or f"{table}_id" in incoming.columns:
        incoming = incoming.drop(f"{table}_id")
    rows = (
        incoming.withColumn("_key", F.struct(*key)).join(F.broadcast(mapping) if few else mapping.hint("merge"), F.col("_key") == F.col("_m_key"))
        .withColumn("first", F.col("is_new") & (F.col("pos") == F.col("_first")))
        .drop("_first", "_key", "_m_key")
    )
    # Read by the next step and for warnings.
    rows = rows if few and every else cut(rows, f"rows-{table}")
    new = complete(plan.filter("is_new"), table, as_of)
    return Resolved(rows, new, rows.filter(~F.col("first")))


def upsert_operation(t: Tables, out: Loaded, docs: DataFrame, as_of: Column) -> DataFrame:
    """Docs plus ``operation_id``; ``docs`` carries the operation's columns."""
    found = get_or_create(t["operation"], docs, "operation", OPERATION_KEY, as_of)
    out.inserts["operation"] = found.new
    out.warnings.append(warn(found.repeats, "already_exists", "operation", "operation_id", "name"))
    return found.found()


def upsert_job(t: Tables, out: Loaded, rows: DataFrame, as_of: Column) -> DataFrame:
    found = get_or_create(t["job"], rows, "job", JOB_KEY, as_of)
    out.inserts["job"] = found.new
    out.warnings.append(warn(found.repeats, "already_exists", "job", "job_id", "name"))
    return found.found()


def upsert_specimen(t: Tables, out: Loaded, rows: DataFrame, as_of: Column) -> DataFrame:
    """By name; a specimen met again in another project stays where it is and is reported."""
    found = get_or_create(
        t["specimen"], rows, "specimen", ("name",), as_of, ("project_id", "cohort", "institution")
    )
    out.inserts["specimen"] = found.new
    _report_moved(t["specimen"], found, out, "specimen", "project_id")
    return found.found()


def _report_moved(table: DataFrame, found: Resolved, out: Loaded, name: str, fk: str) -> None:
    owners = side(table.select(F.col("id").alias("_id"), F.col(fk).alias("_owner")), table)
    known = found.repeats.filter(~F.col("is_new")).join(owners, F.col(f"{name}_id") == F.col("_id"))
    for other, owner in ((known, "_owner"), (found.repeats.filter("is_new"), f"made.{fk}")):
        moved = other.filter(~F.col(owner).eqNullSafe(F.col(fk)))
        out.warnings.append(warn(moved, "belongs_elsewhere", name, f"{name}_id", "name"))


def upsert_sample(t: Tables, out: Loaded, rows: DataFrame, as_of: Column) -> DataFrame:
    """By name; aliases of later occurrences are appended to the stored ones."""
    found = get_or_create(t["sample"], rows, "sample", ("name",), as_of, ("specimen_id", "tumour"))
    named = (
        found.rows.select("sample_id", "pos", F.posexplode("alias").alias("_n", "_alias"))
        .filter(F.col("_alias").isNotNull())
        .groupBy("sample_id", "_alias")
        .agg(F.min(F.struct("pos", "_n")).alias("_at"))
    )
    # Distinct names only reach this list, which is a column of one row by the data model.
    added = named.groupBy("sample_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "_alias"))), lambda x: x["_alias"]).alias("_added")
    )
    added = side(cut(added, "alias"))
    empty = F.array().cast("array<string>")

    def with_alias(samples: DataFrame, how: str) -> DataFrame:
        joined = samples.join(added, samples["id"] == added["sample_id"], how)
        return joined.withColumn("_alias", union_alias(F.col("alias"), F.coalesce("_added", empty)))

    out.inserts["sample"] = with_alias(found.new, "left").withColumn("alias", F.col("_alias")).select(
        *SCHEMAS["sample"].fieldNames()
    )
    changed = with_alias(t["sample"], "inner").filter(
        F.size("_alias") > F.coalesce(F.size("alias"), F.lit(0))
    )
    out.updates["sample"] = cut(
        changed.withColumn("alias", F.col("_alias")).withColumn("modification", as_of)
        .select(*SCHEMAS["sample"].fieldNames()),
        "sample-alias",
    )
    _report_moved(t["sample"], found, out, "sample", "specimen_id")
    return found.found()


def upsert_experiment(t: Tables, out: Loaded, rows: DataFrame, as_of: Column) -> DataFrame:
    found = get_or_create(t["experiment"], rows, "experiment", EXPERIMENT_KEY, as_of)
    out.inserts["experiment"] = found.new
    out.warnings.append(warn(found.repeats, "already_exists", "experiment", "experiment_id", "type"))
    return found.found()


def upsert_run(t: Tables, out: Loaded, rows: DataFrame, as_of: Column) -> DataFrame:
    found = get_or_create(t["run"], rows, "run", RUN_KEY, as_of)
    out.inserts["run"] = found.new
    out.warnings.append(warn(found.repeats, "already_exists", "run", "run_id", "name"))
    return found.found()


def upsert_operation_config(t: Tables, out: Loaded, rows: DataFrame, as_of: Column) -> DataFrame:
    found = get_or_create(t["operation_config"], rows, "operation_config", CONFIG_KEY, as_of)
    out.inserts["operation_config"] = found.new
    out.warnings.append(
        warn(found.repeats, "already_exists", "operation_config", "operation_config_id", "name")
    )
    return found.found()


def upsert_readset(t: Tables, out: Loaded, rows: DataFrame, as_of: Column, extra: Sequence[str]) -> DataFrame:
    """By name; a readset met again under another sample is reported."""
    found = get_or_create(t["readset"], rows, "readset", ("name",), as_of, extra)
    out.inserts["readset"] = found.new
    _report_moved(t["readset"], found, out, "readset", "sample_id")
    return found.found()


def upsert_location(
    t: Tables, out: Loaded, rows: DataFrame, as_of: Column, move: bool
) -> None:
    """Locations by uri, whatever their flags; ``rows`` holds uri, file_id and pos.

    A known uri met under another file is revived and, with ``move``, goes to the file of its
    last occurrence; without ``move`` any occurrence revives it and it stays where it is.
    """
    # Places that are new and come once have nothing to report.
    found = get_or_create(t["location"], rows, "location", ("uri",), as_of, ("file_id",), any_flags=True, every=False)
    out.warnings.append(warn(found.repeats, "already_exists", "location", "location_id", "uri"))
    new = found.new.withColumn("endpoint", before_triple_slash(F.col("uri")))
    out.inserts["location"] = new
    stored = t["location"].unionByName(new).select(
        F.col("id").alias("location_id"), F.col("file_id").alias("_old_file"),
        (F.col("deleted") | F.col("deprecated")).alias("_hidden"),
    )
    met = side(found.rows).join(stored, "location_id")
    if move:
        met = met.filter(F.col("file_id") != F.col("_old_file"))
        # Once moved away, the last occurrence overall has the final say.
        last = found.rows.groupBy("location_id").agg(F.max_by("file_id", "pos").alias("_file"))
        touched = met.select("location_id", "_hidden").distinct().join(last.hint("merge"), "location_id")
    else:
        touched = met.filter("_hidden").select(
            "location_id", "_hidden", F.lit(None).cast("bigint").alias("_file")
        ).distinct()
    touched = side(cut(touched, "revived"))
    out.warnings.append(
        warn(
            met.filter("_hidden").groupBy("location_id", "uri").agg(F.min("pos").alias("pos")),
            "revived", "location", "location_id", "uri",
        )
    )

    def revive(table: DataFrame) -> DataFrame:
        j = table.join(touched, table["id"] == touched["location_id"])
        return j.select(*[
            F.coalesce("_file", "file_id").alias(c) if c == "file_id"
            else F.lit(False).alias(c) if c in ("deleted", "deprecated")
            else as_of.alias(c) if c == "modification"
            else F.col(c)
            for c in table.columns
        ])

    out.updates["location"] = revive(t["location"])
    if move:
        out.inserts["location"] = replace_rows(new, revive(new).withColumn("modification", F.lit(None).cast("timestamp")))


def link(t: Tables, out: Loaded, name: str, pairs: DataFrame) -> None:
    """Queue link pairs that are not stored yet; several calls for one table add up."""
    pairs = pairs.select(*LINK_SCHEMAS[name].fieldNames())
    queued = out.inserts.get(name)
    out.inserts[name] = pairs if queued is None else queued.unionByName(pairs)


def settle_links(t: Tables, out: Loaded) -> None:
    """Keep each queued pair once and only if it is new."""
    for name in LINK_SCHEMAS:
        if name in out.inserts:
            out.inserts[name] = new_links(t[name], out.inserts[name])


def create_project(
    t: Tables, names: DataFrame, as_of: Moment
) -> tuple[DataFrame, DataFrame]:
    """Projects by upper-cased name, whatever the flags: (all rows asked for, new rows).

    ``names`` has a column ``name`` and may have ``ext_id`` and ``ext_src``.
    """
    for c, kind in (("ext_id", "bigint"), ("ext_src", "string")):
        if c not in names.columns:
            names = names.withColumn(c, F.lit(None).cast(kind))
    wanted = names.withColumn("name", upper_name(F.col("name"))).groupBy("name").agg(
        F.min(F.struct("ext_id", "ext_src")).alias("_x")
    ).select("name", "_x.*")
    # Names carry no document; they are numbered in their own order.
    placed = number_documents(wanted, "name").withColumn("pos", place())
    found = get_or_create(
        t["project"], placed, "project", PROJECT_KEY, moment(as_of), ("ext_id", "ext_src"), any_flags=True
    )
    every = t["project"].unionByName(found.new)
    return every.join(wanted.select("name"), "name", "left_semi").select(*t["project"].columns), found.new
