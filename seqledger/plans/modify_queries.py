"""Edits, deletes and cascades by bulk requests; catalog writes; stream arrivals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import modify as m
from ..session import cut, scratch_path
from ..sources.envelopes import read_modifications
from ..sources.tables import changed_buckets, load_tables, write_changes, write_tables
from ..streaming import stream_ingest
from . import reports
from .registry import query


def _ask(rows: DataFrame, table: str, seq: int = 0, column: str | None = None, new: str | None = None) -> DataFrame:
    return rows.select(
        F.lit(table).alias("table"), F.col("id"), F.lit(column).cast("string").alias("column"),
        F.lit(new).cast("string").alias("new"), F.lit(seq).cast("bigint").alias("seq"),
    )


def _every(t, table: str, n: int, rest: int = 0) -> DataFrame:
    return t[table].filter(F.col("id") % n == rest)


def _flagged(before, after, flag: str) -> DataFrame:
    """(table, id, flag) of every row of the tables whose flag changed."""
    parts = []
    for name, df in after.items():
        old = before[name].select("id", F.col(flag).alias("_old"))
        parts.append(df.join(old, "id").filter(F.col(flag) != F.col("_old")).select(
            F.lit(name).alias("table"), "id", F.col(flag).alias("flag")
        ))
    return reduce(DataFrame.unionByName, parts)


def _edits(t):
    return reduce(DataFrame.unionByName, [
        _ask(_every(t, "file", 2), "file", 0, "state", "VALID"),
        _ask(_every(t, "file", 10), "file", 1, "name", "renamed"),
        _ask(_every(t, "file", 20), "file", 2, "name", "again"),
        _ask(_every(t, "file", 30), "file", 3, "deliverable", "true"),
    ])


EDITED = """, edited AS (
  SELECT id, CASE WHEN id % 20 = 0 THEN 'again' WHEN id % 10 = 0 THEN 'renamed' ELSE name END AS name,
    CASE WHEN id % 2 = 0 THEN 'VALID' ELSE state END AS state, id % 30 = 0 OR deliverable AS deliverable FROM e_file)
"""


@query("edited_files", "M-1", EDITED + "SELECT * FROM edited")
def edited_files(t):
    return m.edit(t, _edits(t)).changed["file"].select("id", "name", "state", "deliverable")


@query("edit_report", "M-1", """
SELECT 'edited' AS action, id AS entity_id, 'state: ' || state || ' -> VALID' AS detail FROM e_file WHERE id % 2 = 0 AND state <> 'VALID'
UNION ALL SELECT 'unchanged', id, 'state: VALID -> VALID' FROM e_file WHERE id % 2 = 0 AND state = 'VALID'
UNION ALL SELECT 'edited', id, 'name: ' || name || ' -> renamed' FROM e_file WHERE id % 10 = 0
UNION ALL SELECT 'edited', id, 'name: renamed -> again' FROM e_file WHERE id % 20 = 0
UNION ALL SELECT CASE WHEN deliverable THEN 'unchanged' ELSE 'edited' END, id,
  'deliverable: ' || CAST(deliverable AS VARCHAR) || ' -> true' FROM e_file WHERE id % 30 = 0
""")
def edit_report(t):
    out = m.edit(t, _edits(t))
    return out.report.unionByName(out.warnings).select("action", "entity_id", "detail")


@query("edit_conflicts", "M-1, V-6", """
SELECT 'sample' AS "table", 'twin' AS value, count(*) AS rows FROM e_sample WHERE id % 40 = 3
""")
def edit_conflicts(t):
    out = m.edit(t, _ask(_every(t, "sample", 40, 3), "sample", 0, "name", "twin"))
    return m.edit_conflicts(out.changed)


@query("deleted_samples", "M-2", "SELECT id, deleted OR id % 5 = 0 AS deleted FROM e_sample")
def deleted_samples(t):
    return m.delete(t, _ask(_every(t, "sample", 5), "sample")).changed["sample"].select("id", "deleted")


@query("delete_report", "M-2", """
SELECT CASE WHEN deleted THEN 'already_deleted' ELSE 'deleted' END AS action, 'sample' AS entity, id AS entity_id FROM e_sample WHERE id % 5 = 0
""")
def delete_report(t):
    out = m.delete(t, _ask(_every(t, "sample", 5), "sample"))
    return out.report.unionByName(out.warnings).select("action", "entity", "entity_id")


@query("undeleted_samples", "M-3", "SELECT id, deleted AND id % 2 <> 0 AS deleted FROM e_sample")
def undeleted_samples(t):
    return m.undelete(t, _ask(_every(t, "sample", 2), "sample")).changed["sample"].select("id", "deleted")


@query("deprecated_readsets", "M-4", "SELECT id, deprecated OR id % 6 = 0 AS deprecated FROM e_readset")
def deprecated_readsets(t):
    return m.deprecate(t, _ask(_every(t, "readset", 6), "readset")).changed["readset"].select("id", "deprecated")


@query("undeprecated_readsets", "M-5", "SELECT id, deprecated AND id % 4 <> 0 AS deprecated FROM e_readset")
def undeprecated_readsets(t):
    return m.undeprecate(t, _ask(_every(t, "readset", 4), "readset")).changed["readset"].select("id", "deprecated")


@query("delete_cascade_up", "M-7", """, fresh AS (
  SELECT r.id, r.sample_id, s.specimen_id, s.deleted AS open FROM e_readset r JOIN e_sample s ON s.id = r.sample_id
  WHERE r.id % 3 = 0 AND NOT r.deleted),
trigger AS (SELECT specimen_id, min(id) AS since FROM fresh WHERE open GROUP BY 1),
through AS (SELECT f.* FROM fresh f LEFT JOIN trigger g USING (specimen_id) WHERE open OR f.id > since)
SELECT 'readset' AS "table", id, true AS flag FROM fresh
UNION ALL SELECT DISTINCT 'sample', sample_id, true FROM through JOIN e_sample s ON s.id = sample_id WHERE NOT s.deleted
UNION ALL SELECT DISTINCT 'specimen', specimen_id, true FROM through
""")
def delete_cascade_up(t):
    out = m.delete(t, _ask(_every(t, "readset", 3), "readset"), "cascade_up")
    return _flagged(t, out.changed, "deleted")


@query("deprecate_cascade_up_steps", "M-7, M-4", """, jobs AS (SELECT id, operation_id FROM e_job WHERE id % 4 = 1),
asked AS (SELECT e.id, e.job_id FROM e_metric e WHERE e.id % 3 = 0)
SELECT 'job' AS "table", id, true AS flag FROM jobs
UNION ALL SELECT DISTINCT 'operation', operation_id, true FROM jobs
UNION ALL SELECT 'metric', id, true FROM asked
UNION ALL SELECT DISTINCT 'job', j.id, true FROM asked a JOIN e_job j ON j.id = a.job_id
  WHERE j.operation_id IN (SELECT operation_id FROM jobs) AND j.id NOT IN (SELECT id FROM jobs)
""")
def deprecate_cascade_up_steps(t):
    """Jobs first, which takes their operations along; that opens the way for metrics."""
    asked = _ask(_every(t, "job", 4, 1), "job", 0).unionByName(_ask(_every(t, "metric", 3), "metric", 1))
    return _flagged(t, m.deprecate(t, asked, "cascade_up").changed, "deprecated")


@query("delete_cascade_down", "M-8", """
, dead AS (SELECT id FROM e_specimen WHERE id % 2 = 0),
below AS (SELECT s.* FROM e_sample s WHERE specimen_id IN (SELECT id FROM dead) AND (
  s.deleted OR NOT EXISTS (SELECT 1 FROM e_readset r WHERE r.sample_id = s.id AND NOT r.deleted)))
SELECT 'specimen' AS "table", id, true AS flag FROM dead
UNION ALL SELECT 'sample', id, true FROM below WHERE NOT deleted
UNION ALL SELECT 'readset', r.id, true FROM e_readset r WHERE NOT r.deleted AND r.sample_id IN (SELECT id FROM below)
""")
def delete_cascade_down(t):
    out = m.delete(t, _ask(_every(t, "specimen", 2), "specimen"), "cascade_down")
    return _flagged(t, out.changed, "deleted")


@query("deprecate_project_cascade_down", "M-8", """
, ops AS (SELECT id FROM e_operation o WHERE project_id IN (1, 3) AND NOT EXISTS (SELECT 1 FROM e_job j WHERE j.operation_id = o.id)),
specs AS (SELECT id FROM e_specimen p WHERE project_id IN (1, 3) AND NOT EXISTS (SELECT 1 FROM e_sample s WHERE s.specimen_id = p.id AND NOT s.deprecated))
SELECT 'project' AS "table", id, true AS flag FROM e_project WHERE id IN (1, 3)
UNION ALL SELECT 'operation', id, true FROM ops UNION ALL SELECT 'specimen', id, true FROM specs
""")
def deprecate_project_cascade_down(t):
    asked = _ask(t["project"].filter(F.col("id").isin(1, 3)), "project")
    return _flagged(t, m.deprecate(t, asked, "cascade_down").changed, "deprecated")


@query("undelete_cascade", "M-9, M-3", """
SELECT 'sample' AS "table", id, false AS flag FROM e_sample WHERE deleted AND id % 2 = 0
UNION ALL SELECT 'readset', r.id, false FROM e_readset r JOIN e_sample s ON s.id = r.sample_id WHERE r.deleted AND s.deleted AND s.id % 2 = 0
""")
def undelete_cascade(t):
    out = m.undelete(t, _ask(_every(t, "sample", 2), "sample"), "cascade")
    return _flagged(t, out.changed, "deleted")


@query("undelete_cascade_up", "M-9", """
SELECT 'readset' AS "table", id, false AS flag FROM e_readset WHERE deleted AND id % 2 = 0
UNION ALL SELECT DISTINCT 'sample', s.id, false FROM e_readset r JOIN e_sample s ON s.id = r.sample_id WHERE r.deleted AND s.deleted AND r.id % 2 = 0
""")
def undelete_cascade_up(t):
    out = m.undelete(t, _ask(_every(t, "readset", 2), "readset"), "cascade_up")
    return _flagged(t, out.changed, "deleted")


def _left(t, changed) -> DataFrame:
    """Rows left per table."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n, df in sorted(changed.items())]
    return reduce(DataFrame.unionByName, parts)


@query("curated_specimens", "M-6", """
, gone AS (SELECT r.id FROM e_readset r JOIN e_sample s ON s.id = r.sample_id WHERE s.specimen_id IN (3, 5, 8))
SELECT 'specimen' AS name, count(*) AS n FROM e_specimen WHERE id NOT IN (3, 5, 8)
UNION ALL SELECT 'sample', count(*) FROM e_sample WHERE specimen_id NOT IN (3, 5, 8)
UNION ALL SELECT 'readset', count(*) FROM e_readset WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'readset_file', count(*) FROM e_readset_file WHERE readset_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'readset_metric', count(*) FROM e_readset_metric WHERE readset_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'readset_job', count(*) FROM e_readset_job WHERE readset_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'readset_operation', count(*) FROM e_readset_operation WHERE readset_id NOT IN (SELECT id FROM gone)
""")
def curated_specimens(t):
    asked = _ask(t["specimen"].filter(F.col("id").isin(3, 5, 8)), "specimen")
    return _left(t, m.curate(t, asked).changed)


@query("curated_operations", "M-6", """
, ops AS (SELECT id FROM e_operation WHERE operation_config_id = 2), jobs AS (SELECT id FROM e_job WHERE operation_id IN (SELECT id FROM ops)),
ms AS (SELECT id FROM e_metric WHERE job_id IN (SELECT id FROM jobs))
SELECT 'operation_config' AS name, count(*) AS n FROM e_operation_config WHERE id <> 2
UNION ALL SELECT 'operation', count(*) FROM e_operation WHERE id NOT IN (SELECT id FROM ops)
UNION ALL SELECT 'job', count(*) FROM e_job WHERE id NOT IN (SELECT id FROM jobs)
UNION ALL SELECT 'metric', count(*) FROM e_metric WHERE id NOT IN (SELECT id FROM ms)
UNION ALL SELECT 'readset_metric', count(*) FROM e_readset_metric WHERE metric_id NOT IN (SELECT id FROM ms)
UNION ALL SELECT 'readset_job', count(*) FROM e_readset_job WHERE job_id NOT IN (SELECT id FROM jobs)
UNION ALL SELECT 'job_file', count(*) FROM e_job_file WHERE job_id NOT IN (SELECT id FROM jobs)
UNION ALL SELECT 'readset_operation', count(*) FROM e_readset_operation WHERE operation_id NOT IN (SELECT id FROM ops)
""")
def curated_operations(t):
    asked = _ask(t["operation_config"].filter("id = 2"), "operation_config")
    return _left(t, m.curate(t, asked).changed)


@query("curate_cascade_up", "M-10", """
, gone AS (SELECT DISTINCT file_id AS id FROM e_location WHERE id % 9 = 0)
SELECT 'file' AS name, count(*) AS n FROM e_file WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'location', count(*) FROM e_location WHERE id % 9 <> 0 AND file_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'readset_file', count(*) FROM e_readset_file WHERE file_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'job_file', count(*) FROM e_job_file WHERE file_id NOT IN (SELECT id FROM gone)
""")
def curate_cascade_up(t):
    return _left(t, m.curate(t, _ask(_every(t, "location", 9), "location"), "cascade_up").changed)


@query("read_modifications", "S-6", """
SELECT 'sample' AS "table", 'tumour' AS "column", 'true' AS new, id, id % 4 AS seq FROM e_sample
""")
def read_modification_requests(t):
    # Ids of one entry come from one sample each, so no list grows with the table.
    entry = F.struct(F.lit("sample").alias("table"), F.array("id", "id").alias("id"), F.lit("tumour").alias("column"), F.lit("true").alias("new"))
    skip = F.struct(F.lit("sample").alias("table"), F.array().cast("array<bigint>").alias("id"), F.lit("tumour").alias("column"), F.lit("true").alias("new"))
    entries = F.concat(F.array_repeat(skip, (F.col("id") % 4).cast("int")), F.array(entry))
    path = scratch_path(t["project"].sparkSession, "requests")
    t["sample"].select(F.to_json(F.struct(entries.alias("modification")))).write.text(path)
    rows = read_modifications(t["project"].sparkSession, path, multi_line=False).filter(F.col("id").isNotNull())
    return rows.select("table", "column", "new", "id", "seq")


@query("written_catalog", "S-7, S-1", """
SELECT 'location' AS name, id, deleted OR id % 3 = 0 AS deleted, uri AS what FROM e_location UNION ALL SELECT 'file', id, deleted, name FROM e_file
""")
def written_catalog(t):
    """Two versions, the second with one changed table; a dry run in between."""
    spark = t["project"].sparkSession
    base = scratch_path(spark, "catalog")
    write_tables(spark, base, {"location": t["location"], "file": t["file"]})
    first = load_tables(spark, base)
    out = m.apply(first, "delete", _ask(_every(first, "location", 3), "location"))
    write_tables(spark, base, {"file": t["file"].filter(F.lit(False))}, dry_run=True)
    write_tables(spark, base, out.changed)
    last = load_tables(spark, base)
    location = last["location"].select(F.lit("location").alias("name"), "id", "deleted", F.col("uri").alias("what"))
    return location.unionByName(last["file"].select(F.lit("file").alias("name"), "id", "deleted", F.col("name").alias("what")))


@query("revived_location_bucket", "S-7, S-1, I-20", """
, one AS (SELECT max(id) AS id FROM e_location WHERE deleted OR id % 3 = 0)
SELECT 'row' AS part, l.id, (l.deleted OR l.id % 3 = 0) AND l.id <> one.id AS flag, l.id % 32 AS bucket FROM e_location l, one
UNION ALL SELECT 'old row', l.id, l.deleted OR l.id % 3 = 0, l.id % 32 FROM e_location l
UNION ALL SELECT 'bucket', NULL, l.id % 32 = any_value(one.id) % 32, l.id % 32 FROM e_location l, one GROUP BY l.id % 32
""")
def revived_location_bucket(t):
    """One location revived in a catalog: the rows, those of the version before, and which buckets were written."""
    spark = t["project"].sparkSession
    base = scratch_path(spark, "catalog")
    gone = t["location"].withColumn("deleted", F.col("deleted") | (F.col("id") % 3 == 0))
    write_tables(spark, base, {"location": gone}, buckets=32)
    one = load_tables(spark, base)["location"].filter("deleted").orderBy(F.desc("id")).limit(1)
    version = write_changes(spark, base, updated={"location": cut(one.withColumn("deleted", F.lit(False)), "revived")})

    def rows(part, version=None):
        found = load_tables(spark, base, version)["location"]
        return found.select(F.lit(part).alias("part"), "id", F.col("deleted").alias("flag"), F.expr("id % 32").alias("bucket"))

    written = changed_buckets(spark, base, version).select(
        F.lit("bucket").alias("part"), F.lit(None).cast("bigint").alias("id"), F.col("written").alias("flag"), F.col("bucket").cast("bigint").alias("bucket"))
    return rows("row").unionByName(rows("old row", version - 1)).unionByName(written)


@query("streamed_transfers", "I-20, I-16", """
SELECT endpoint, endpoint || ':///run/' || readset_id || '/' || file_id AS uri FROM e_readset_file, (VALUES ('alpha'), ('bravo')) e(endpoint)
""")
def streamed_transfers(t):
    """Transfer reports arriving as files, loaded by a stream into a catalog on disk; started
    a second time, the stream finds nothing new."""
    spark = t["project"].sparkSession
    base = scratch_path(spark, "catalog")
    write_tables(spark, base, reports.loaded_runs(t)[1])
    folder = reports.move_reports(t, "alpha", "bravo")
    for _ in range(2):
        stream = stream_ingest(
            spark, folder, "transfer", base, f"{base}-checkpoint", multi_line=False, as_of=reports.AS_OF
        )
        stream.awaitTermination()
    return load_tables(spark, base)["location"].select("endpoint", "uri")
