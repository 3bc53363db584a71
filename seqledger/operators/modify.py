"""Edits, soft and hard deletes, and their cascades.

A request is a DataFrame (table, id, column, new, seq); ``seq`` is the position of its entry
in the request.  Entries apply in order of ``seq``; the ids of one entry in ascending order.
The entity graph has fixed depth, so cascades are a few unrolled joins.

Each function returns ``Outcome``: changed tables, a report of what was done, warnings, and
the ids that do not exist.  A request with unknown ids is to be refused by the caller (the
``missing`` frame is not empty); ``apply`` does so.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schemas import DOMAINS, ENTITY_SCHEMAS, FOREIGN_KEYS, LINK_SCHEMAS, UNIQUE_COLUMNS
from ..session import cut
from .entities import Tables
from .grouping import change_runs, only_ids, previous_value, without_ids
from .ingest.base import Moment, moment
from .validate import missing_ids, unique_violations

REPORT = "action string, entity string, entity_id bigint, detail string"
REQUEST = "table string, id bigint, column string, new string, seq bigint"

CASCADE_MODES = (None, "cascade", "cascade_up", "cascade_down")

# Parents a cascade climbs to, as child -> (parent, key column).
PARENTS = {
    "readset": ("sample", "sample_id"),
    "sample": ("specimen", "specimen_id"),
    "job": ("operation", "operation_id"),
    "metric": ("job", "job_id"),
    "location": ("file", "file_id"),
}

# Children a cascade descends to, as parent -> (child, key column).
CHILDREN = {
    "project": (("specimen", "project_id"), ("operation", "project_id")),
    "specimen": (("sample", "specimen_id"),),
    "sample": (("readset", "sample_id"),),
    "run": (("readset", "run_id"),),
    "operation": (("job", "operation_id"),),
    "operation_config": (("operation", "operation_config_id"),),
    "reference": (("operation", "reference_id"),),
    "job": (("metric", "job_id"),),
    "file": (("location", "file_id"),),
}


@dataclass
class Outcome:
    changed: Tables = field(default_factory=dict)
    report: DataFrame | None = None
    warnings: DataFrame | None = None
    missing: DataFrame | None = None


def request_frame(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """A request given as a small literal list of {table, id[], column, new}."""
    rows = [
        (e["table"], int(i), e.get("column"), None if e.get("new") is None else str(e["new"]), n)
        for n, e in enumerate(entries)
        for i in sorted(set(e["id"]))
    ]
    return spark.createDataFrame(rows, REQUEST)


def _steps(mods: DataFrame, ordered: bool) -> list[tuple[str, int, int]]:
    """(table, first seq, last seq) of the steps of a request.

    Without cascades the entries of one table do not depend on others and form one step.
    With cascades, neighbouring entries of one table form a step.
    """
    spans = mods.groupBy("table").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    if ordered:
        entries = mods.groupBy("seq").agg(F.min("table").alias("table"))
        runs = change_runs(
            entries.select(F.lit(0).alias("k"), "table", F.struct(F.col("seq").alias("doc")).alias("pos")),
            ["k"], "table",
        )
        spans = runs.groupBy("run", "table").agg(
            F.min("pos.doc").alias("lo"), F.max("pos.doc").alias("hi")
        )
    rows = [(r["table"], r["lo"], r["hi"]) for r in spans.collect()]
    unknown = {r[0] for r in rows} - set(ENTITY_SCHEMAS)
    if unknown:
        raise ValueError(f"unknown tables: {sorted(unknown)}")
    return sorted(rows, key=lambda r: (r[1], r[0]))


def _tables_of(mods: DataFrame) -> list[str]:
    return sorted({step[0] for step in _steps(mods, ordered=False)})


def _report(rows: DataFrame, action: str, entity: str, detail: Column | None = None) -> DataFrame:
    return rows.select(
        F.lit(action).alias("action"),
        F.lit(entity).alias("entity"),
        F.col("id").alias("entity_id"),
        (F.lit(None) if detail is None else detail).cast("string").alias("detail"),
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _all_missing(t: Tables, mods: DataFrame, tables: list[str]) -> DataFrame:
    return _union([
        missing_ids(t, name, mods.filter(F.col("table") == name)).select(F.lit(name).alias("table"), "id")
        for name in tables
    ])


# --- edit -----------------------------------------------------------------------------------


def _as_text(col: Column, schema: StructType, name: str) -> Column:
    kind = schema[name].dataType.typeName()
    return F.to_json(col) if kind == "array" else F.decode(col, "UTF-8") if kind == "binary" else col.cast("string")


def _from_text(col: Column, schema: StructType, name: str) -> Column:
    kind = schema[name].dataType
    if kind.typeName() == "array":
        return F.from_json(col, kind.simpleString())
    return F.encode(col, "UTF-8") if kind.typeName() == "binary" else col.cast(kind)


def edit(t: Tables, mods: DataFrame) -> Outcome:
    """Set columns by id.  Edits of one cell follow each other in order of ``seq``; an edit to
    the value the cell already has is skipped with a warning."""
    out = Outcome(missing=_all_missing(t, mods, _tables_of(mods)))
    reports, warnings = [], []
    for name in _tables_of(mods):
        schema = t[name].schema
        mine = mods.filter(F.col("table") == name).select("id", "column", "new", "seq").distinct()
        columns = [r["column"] for r in mine.select("column").distinct().collect()]
        bad = set(columns) - set(schema.fieldNames())
        if bad or "id" in columns:
            raise ValueError(f"{name} has no editable columns {sorted(bad) or ['id']}")
        rows = t[name].join(mine.select("id").distinct(), "id", "left_semi")
        cells = rows.select(
            "id", F.explode(F.array(*[
                F.struct(F.lit(c).alias("column"), _as_text(F.col(c), schema, c).alias("old"))
                for c in columns
            ])).alias("cell"),
        ).select("id", "cell.column", "cell.old")
        steps = mine.join(cells, ["id", "column"])
        # The first edit of a cell compares with the stored value, a later one with the edit
        # before it.
        steps = previous_value(
            steps.withColumn("pos", F.struct(F.col("seq").alias("doc"))), ["id", "column"], "new"
        ).withColumn(
            "old", F.when(F.col("previous").isNotNull(), F.col("previous.v")).otherwise(F.col("old"))
        )
        same = F.col("old").eqNullSafe(F.col("new"))
        detail = F.concat(
            F.col("column"), F.lit(": "), F.coalesce("old", F.lit("null")), F.lit(" -> "),
            F.coalesce("new", F.lit("null")),
        )
        reports.append(_report(steps.filter(~same), "edited", name, detail))
        warnings.append(_report(steps.filter(same), "unchanged", name, detail))
        last = mine.groupBy("id").agg(*[
            F.max_by(F.struct("new"), "seq").alias(f"_new_{c}") if len(columns) == 1 else
            F.max_by(
                F.when(F.col("column") == c, F.struct("new")), F.when(F.col("column") == c, F.col("seq"))
            ).alias(f"_new_{c}")
            for c in columns
        ])
        out.changed[name] = t[name].join(last, "id", "left").select(*[
            F.when(F.col(f"_new_{c}").isNotNull(), _from_text(F.col(f"_new_{c}.new"), schema, c))
            .otherwise(F.col(c)).alias(c)
            if c in columns else F.col(c)
            for c in t[name].columns
        ])
    out.report, out.warnings = _union(reports), _union(warnings)
    return out


def edit_conflicts(changed: Tables) -> DataFrame | None:
    """Unique columns that an edit made ambiguous: (table, value, rows)."""
    parts = [
        unique_violations(df, UNIQUE_COLUMNS[name]).select(F.lit(name).alias("table"), "value", "rows")
        for name, df in changed.items() if name in UNIQUE_COLUMNS
    ]
    return _union(parts) if parts else None


def edit_domain_errors(mods: DataFrame) -> DataFrame:
    """Edits to a value outside the domain of their column: (table, id, column, new, seq)."""
    outside = [(F.col("column") == c) & ~F.col("new").isin(list(values)) for c, values in DOMAINS.items()]
    return mods.filter(reduce(lambda a, b: a | b, outside))


# --- soft delete and its relatives ----------------------------------------------------------


def _set_flag(table: DataFrame, ids: DataFrame, flag: str, value: bool) -> DataFrame:
    hit = ids.select(F.col("id").alias("_hit")).distinct()
    joined = table.join(hit, table["id"] == hit["_hit"], "left")
    return joined.select(*[
        F.when(F.col("_hit").isNotNull(), F.lit(value)).otherwise(F.col(c)).alias(c) if c == flag else F.col(c)
        for c in table.columns
    ])


def _climb(t: Tables, child: str, frontier: DataFrame, flag: str) -> list[tuple[str, DataFrame]]:
    """Parents to flag above newly flagged ``frontier`` rows, level by level.

    A parent is flagged if it has no parents of its own, if its own parent is flagged, or if
    it already carries the flag (the climb then goes on through it).  Ids of an entry count in
    ascending order: an id whose climb reaches the grandparent opens the way for every higher
    id under that grandparent.
    """
    if child not in PARENTS:
        return []
    parent, fk = PARENTS[child]
    # Turn of an id: its entry, then its value.
    turns = frontier.select("id", F.struct("seq", "id").alias("_turn"))
    own = t[child].select("id", fk).join(turns, "id")
    if parent not in PARENTS:
        return [(parent, own.filter(F.col(fk).isNotNull()).select(F.col(fk).alias("id")).distinct())]
    grand, gfk = PARENTS[parent]
    p = t[parent].select(F.col("id").alias("_p"), F.col(gfk).alias("_g"), F.col(flag).alias("_p_flag"))
    g = t[grand].select(F.col("id").alias("_gid"), F.col(flag).alias("_g_flag"))
    path = (
        own.join(p, own[fk] == p["_p"])
        .join(g, F.col("_g") == g["_gid"], "left")
        .withColumn("_open", F.col("_p_flag") | F.col("_gid").isNull() | F.col("_g_flag"))
    )
    # The first id of the step that gets through to each grandparent.
    trigger = path.filter("_open").groupBy(F.col("_g").alias("_tg")).agg(F.min("_turn").alias("_from"))
    through = path.join(trigger, F.col("_g") == F.col("_tg"), "left").filter(
        F.col("_open") | (F.col("_turn") > F.col("_from"))
    )
    parents = through.select(F.col("_p").alias("id"), "_g").distinct()
    return [
        (parent, parents.select("id").distinct()),
        (grand, parents.filter(F.col("_g").isNotNull()).select(F.col("_g").alias("id")).distinct()),
    ]


def cascade_up(t: Tables, table: str, frontier: DataFrame, flag: str) -> list[tuple[str, DataFrame]]:
    """(table, ids) of the parents a delete or deprecate reaches from ``frontier``."""
    return _climb(t, table, frontier, flag)


def _childless(t: Tables, table: str, flag: str) -> DataFrame:
    """Rows of ``table`` that are flagged or have no unflagged child."""
    rows = t[table].select("id", F.col(flag).alias("_flag"))
    plain = rows.filter(~F.col("_flag"))
    for child, fk in CHILDREN.get(table, ()):
        plain = without_ids(plain, t[child].filter(~F.col(flag)), "id", fk)
    return rows.filter("_flag").unionByName(plain).select("id")


def cascade_down(t: Tables, table: str, frontier: DataFrame, flag: str) -> list[tuple[str, DataFrame]]:
    """(table, ids) of the children a delete or deprecate reaches from ``frontier``.

    A child is reached when all of its own children carry the flag already; entities without
    children of their own are reached directly.
    """
    reached = []
    for child, fk in CHILDREN.get(table, ()):
        below = only_ids(t[child].select("id", fk), frontier, fk).select("id")
        ok = below if child not in CHILDREN else only_ids(below, _childless(t, child, flag))
        reached.append((child, ok))
        reached.extend(cascade_down(t, child, ok, flag))
    return reached


def cascade_restore(
    t: Tables, table: str, frontier: DataFrame, flag: str, direction: str
) -> list[tuple[str, DataFrame]]:
    """(table, ids) that an undelete or undeprecate clears: every flagged parent, or child,
    in an unbroken chain of flagged ones."""
    reached = []
    if direction == "parents":
        if table in PARENTS:
            parent, fk = PARENTS[table]
            above = t[table].join(frontier.select("id").distinct(), "id", "left_semi")
            hit = only_ids(t[parent].filter(F.col(flag)), above, "id", fk).select("id")
            reached.append((parent, hit))
            reached.extend(cascade_restore(t, parent, hit, flag, direction))
        return reached
    for child, fk in CHILDREN.get(table, ()):
        hit = only_ids(t[child].filter(F.col(flag)).select("id", fk), frontier, fk).select("id")
        reached.append((child, hit))
        reached.extend(cascade_restore(t, child, hit, flag, direction))
    return reached


def _flag_request(
    t: Tables, mods: DataFrame, flag: str, value: bool, done: str, cascade: str | None
) -> Outcome:
    if cascade not in CASCADE_MODES:
        raise ValueError(f"cascade must be one of {CASCADE_MODES}")
    steps = _steps(mods, ordered=cascade is not None)
    out = Outcome(missing=_all_missing(t, mods, sorted({x[0] for x in steps})))
    state = dict(t)
    reports, warnings = [], []
    for n, (table, lo, hi) in enumerate(steps):
        asked = mods.filter((F.col("table") == table) & F.col("seq").between(lo, hi))
        first = asked.groupBy("id").agg(F.min("seq").alias("seq"))
        again = asked.select("id", "seq").distinct().join(first, ["id", "seq"], "left_anti")
        rows = state[table].select("id", F.col(flag).alias("_is")).join(first, "id")
        fresh = rows.filter(F.col("_is") != value).select("id", "seq")
        if cascade or len(steps) > 1:
            # Fixed before the tables it came from change.
            fresh = cut(fresh, "flagged")
        known = rows.filter(F.col("_is") == value).select("id").unionByName(
            only_ids(again, state[table]).select("id")
        )
        warnings.append(_report(known, f"already_{done}", table))
        reports.append(_report(fresh, done, table))
        state[table] = _set_flag(state[table], fresh, flag, value)
        out.changed[table] = state[table]
        for direction, modes in (("children", ("cascade", "cascade_down")), ("parents", ("cascade", "cascade_up"))):
            if cascade not in modes:
                continue
            if not value:
                hits = cascade_restore(state, table, fresh, flag, direction)
            elif direction == "children":
                hits = cascade_down(state, table, fresh, flag)
            else:
                hits = cascade_up(state, table, fresh, flag)
            for name, reached in hits:
                reached = cut(reached, "reached")
                # Only rows that really change are reported.
                moved = only_ids(state[name], reached).filter(F.col(flag) != value)
                reports.append(_report(moved, done, name))
                state[name] = _set_flag(state[name], reached, flag, value)
                out.changed[name] = state[name]
        if n + 1 < len(steps) and cascade:
            for name in out.changed:
                state[name] = out.changed[name] = cut(state[name], f"state-{name}")
    out.report, out.warnings = _union(reports), _union(warnings)
    return out


def delete(t: Tables, mods: DataFrame, cascade: str | None = None) -> Outcome:
    """Soft delete."""
    return _flag_request(t, mods, "deleted", True, "deleted", cascade)


def undelete(t: Tables, mods: DataFrame, cascade: str | None = None) -> Outcome:
    return _flag_request(t, mods, "deleted", False, "undeleted", cascade)


def deprecate(t: Tables, mods: DataFrame, cascade: str | None = None) -> Outcome:
    return _flag_request(t, mods, "deprecated", True, "deprecated", cascade)


def undeprecate(t: Tables, mods: DataFrame, cascade: str | None = None) -> Outcome:
    return _flag_request(t, mods, "deprecated", False, "undeprecated", cascade)


# --- hard delete ----------------------------------------------------------------------------


def _erase_order() -> list[str]:
    """Entity tables with every parent before its children."""
    order: list[str] = []
    names = list(ENTITY_SCHEMAS)
    while names:
        free = [n for n in names if not any(c == n and p in names for p, c, _ in FOREIGN_KEYS)]
        order += free
        names = [n for n in names if n not in free]
    return order


def erased_ids(t: Tables, roots: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Ids per table that go when ``roots`` go: all rows below them along the foreign keys."""
    gone: dict[str, DataFrame] = {}
    for name in _erase_order():
        parts = [roots[name].select("id")] if name in roots else []
        for parent, child, fk in FOREIGN_KEYS:
            if child == name and parent in gone:
                parts.append(only_ids(t[name].select("id", fk), gone[parent], fk).select("id"))
        if parts:
            gone[name] = cut(_union(parts).distinct(), f"erased-{name}")
    return gone


def erase(t: Tables, roots: dict[str, DataFrame]) -> Tables:
    """Tables without the rows of ``roots``, everything below them and every link to those."""
    gone = erased_ids(t, roots)
    out: Tables = {name: without_ids(t[name], ids) for name, ids in gone.items()}
    for link, schema in LINK_SCHEMAS.items():
        rows, hit = t[link], False
        for col in schema.fieldNames():
            entity = col.removesuffix("_id")
            if entity in gone:
                rows, hit = without_ids(rows, gone[entity], col), True
        if hit:
            out[link] = rows
    return out


def cascade_curate(t: Tables, table: str, ids: DataFrame, direction: str) -> list[tuple[str, DataFrame]]:
    """(table, ids) a hard delete reaches: parents that have no parent themselves; or children
    that have no children themselves."""
    if direction == "parents":
        if table not in PARENTS:
            return []
        parent, fk = PARENTS[table]
        above = only_ids(t[parent], t[table].join(ids.select("id").distinct(), "id", "left_semi"), "id", fk)
        if parent in PARENTS:
            grand, gfk = PARENTS[parent]
            above = without_ids(above, t[grand], gfk)
        return [(parent, above.select("id"))]
    reached = []
    for child, fk in CHILDREN.get(table, ()):
        below = only_ids(t[child].select("id", fk), ids, fk).select("id")
        for grandchild, gfk in CHILDREN.get(child, ()):
            below = without_ids(below, t[grandchild], "id", gfk)
        reached.append((child, below))
    return reached


def curate(t: Tables, mods: DataFrame, cascade: str | None = None) -> Outcome:
    """Hard delete by id, with everything below and all links."""
    if cascade not in CASCADE_MODES:
        raise ValueError(f"cascade must be one of {CASCADE_MODES}")
    tables = _tables_of(mods)
    roots: dict[str, DataFrame] = {}

    def add(name: str, ids: DataFrame) -> None:
        roots[name] = ids if name not in roots else roots[name].unionByName(ids)

    for name in tables:
        ids = only_ids(t[name], mods.filter(F.col("table") == name)).select("id")
        add(name, ids)
        if cascade in ("cascade", "cascade_down"):
            for child, reached in cascade_curate(t, name, ids, "children"):
                add(child, reached)
        if cascade in ("cascade", "cascade_up"):
            for parent, reached in cascade_curate(t, name, ids, "parents"):
                add(parent, reached)
    roots = {name: cut(ids.distinct(), f"curated-{name}") for name, ids in roots.items()}
    report = _union([_report(ids, "permanently_deleted", name) for name, ids in roots.items()])
    return Outcome(
        changed=erase(t, roots),
        report=report,
        warnings=t["project"].sparkSession.createDataFrame([], REPORT),
        missing=_all_missing(t, mods, tables),
    )


ACTIONS = {
    "edit": edit,
    "delete": delete,
    "undelete": undelete,
    "deprecate": deprecate,
    "undeprecate": undeprecate,
    "curate": curate,
}


def cascade_mode(cascade: bool = False, cascade_up: bool = False, cascade_down: bool = False) -> str | None:
    """The mode named by the request's switches; at most one may be set."""
    given = [n for n, on in (("cascade", cascade), ("cascade_up", cascade_up), ("cascade_down", cascade_down)) if on]
    if len(given) > 1:
        raise ValueError("only one of cascade, cascade_up and cascade_down may be set")
    return given[0] if given else None


def _stamped(table: DataFrame, name: str, report: DataFrame, as_of: Moment) -> DataFrame:
    done = report.filter(F.col("entity") == name).select(F.col("entity_id").alias("_done")).distinct()
    return table.join(done, table["id"] == done["_done"], "left").select(*[
        F.when(F.col("_done").isNotNull(), moment(as_of)).otherwise(F.col(c)).alias(c) if c == "modification" else F.col(c)
        for c in table.columns
    ])


def apply(
    t: Tables, action: str, mods: DataFrame, cascade: str | None = None, dry_run: bool = False,
    as_of: Moment | None = None,
) -> Outcome:
    """Run one action; unknown ids, edits to values outside a domain and edits that break a
    unique column refuse it whole.

    Entries without ids are warned of and left out.  ``as_of`` is written as the modification
    time of every row that changed; without it the column stays.  A dry run returns the report
    without changed tables.
    """
    empty = mods.filter(F.col("id").isNull()).select(
        F.lit("no_ids").alias("action"), F.col("table").alias("entity"), F.col("id").alias("entity_id"),
        F.concat(F.lit("entry "), F.col("seq")).alias("detail"),
    )
    mods = mods.filter(F.col("id").isNotNull())
    if mods.isEmpty():
        none = empty.filter(F.lit(False))
        return Outcome(report=none, warnings=empty)
    if action == "edit":
        outside = edit_domain_errors(mods)
        if not outside.isEmpty():
            raise ValueError(f"values outside their domain: {outside.limit(20).collect()}")
    out = edit(t, mods) if action == "edit" else ACTIONS[action](t, mods, cascade)
    out.warnings = out.warnings.unionByName(empty)
    if out.missing is not None and not out.missing.isEmpty():
        raise LookupError(f"unknown ids: {out.missing.limit(20).collect()}")
    if action == "edit":
        clashes = edit_conflicts(out.changed)
        if clashes is not None and not clashes.isEmpty():
            raise ValueError(f"values no longer unique: {clashes.limit(20).collect()}")
    if dry_run:
        out.changed = {}
    if as_of is not None:
        out.changed = {
            name: _stamped(table, name, out.report, as_of) if name in ENTITY_SCHEMAS else table
            for name, table in out.changed.items()
        }
    return out
