"""Reports nested from the tables, loaded, and compared with the tables they came from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import validate as v
from ..operators.ingest import ingest_transfer
from ..operators.ingest.base import number, readable
from ..session import cut
from ..sources.envelopes import read_delivery, read_pipeline_run, read_run_processing, read_transfer
from . import reports
from .registry import query

NAMES = """, named AS (
  SELECT r.id AS readset_id, r.name AS readset_name, r.lane, r.sequencing_type, r.run_id, s.name AS sample_name, s.tumour,
    p.name AS specimen_name, p.cohort, j.name AS project_name, e.nucleic_acid_type, e.library_kit, u.name AS run_name
  FROM e_readset r JOIN e_sample s ON s.id = r.sample_id JOIN e_specimen p ON p.id = s.specimen_id
  JOIN e_project j ON j.id = p.project_id JOIN e_experiment e ON e.id = r.experiment_id JOIN e_run u ON u.id = r.run_id)
"""


def _grown(df):
    """A side that grows with the data is merged: by the size of its well compressed files it would be sent to all tasks."""
    return df.hint("merge")


def _name(t, table, *cols):
    return t[table].select(F.col("id").alias(f"{table}_id"), *[F.col(c).alias(f"{table}_{c}") for c in ("name", *cols)])


# --- documents that can't be read --------------------------------------------------------------

KINDS = {"run_processing": "specimen", "transfer": "readset", "pipeline_run": "sample", "delivery": "readset"}


def _damaged(t, kind):
    spark = t["project"].sparkSession
    made = {
        "run_processing": lambda: reports.run_processing_reports(t), "transfer": lambda: reports.move_reports(t, "alpha", "bravo"),
        "pipeline_run": lambda: reports.pipeline_reports(t), "delivery": lambda: reports.move_reports(t, "bravo", "handoff", True),
    }
    return reports.damaged(spark, made[kind](), KINDS[kind])


@query("unreadable_documents", "S-2, S-3, S-4, S-5", """
, kind AS (SELECT unnest(['run_processing', 'transfer', 'pipeline_run', 'delivery']) AS kind),
report AS (
  SELECT kind, r.id AS readset_id FROM kind, e_readset r
  WHERE kind IN ('run_processing', 'pipeline_run') OR EXISTS (SELECT 1 FROM e_readset_file f WHERE f.readset_id = r.id))
SELECT kind, readset_id, 'unreadable' AS code FROM report WHERE readset_id % 4 <> 0
UNION ALL SELECT kind, NULL, 'unreadable' FROM kind
""")
def unreadable_documents(t):
    """Error rows of cut-off, wrong-typed, senseless and empty documents of all four kinds."""
    readers = {"run_processing": read_run_processing, "transfer": read_transfer, "pipeline_run": read_pipeline_run, "delivery": read_delivery}
    parts = []
    for kind, read in readers.items():
        docs = cut(number(read(t["project"].sparkSession, _damaged(t, kind), multi_line=False)), "docs")
        found = readable(docs)[1].join(docs.select("doc", "unreadable"), "doc")
        asked = F.regexp_extract("unreadable", '"readset_id":([0-9]+)', 1)
        parts.append(found.select(F.lit(kind).alias("kind"), F.when(asked != "", asked.cast("bigint")).alias("readset_id"), "code"))
    # A part file without lines may come from an empty partition too.
    return reduce(DataFrame.unionByName, parts).distinct()


@query("loaded_beside_unreadable", "S-3, I-16, V-4", NAMES + """
SELECT 'location' AS entity, 'bravo:///run/' || readset_id || '/' || file_id AS what FROM named JOIN e_readset_file USING (readset_id) WHERE readset_id % 4 = 0
UNION ALL SELECT 'error', 'unreadable ' || count(*) FROM (
  SELECT readset_id FROM named JOIN e_readset_file USING (readset_id) WHERE readset_id % 4 <> 0 GROUP BY readset_id)
""")
def loaded_beside_unreadable(t):
    """What a transfer of damaged reports puts into the tables: only what the good ones say."""
    base = reports.loaded_runs(t)[1]
    docs = read_transfer(t["project"].sparkSession, _damaged(t, "transfer"), multi_line=False)
    out = ingest_transfer(base, docs.filter("unreadable IS NULL OR unreadable <> ''"), reports.AS_OF)
    errors = out.errors.groupBy("code").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("error").alias("entity"), F.concat_ws(" ", "code", F.col("n").cast("string")).alias("what"))
    return out.inserts["location"].select(F.lit("location").alias("entity"), F.col("uri").alias("what")).unionByName(errors)


# --- reading --------------------------------------------------------------------------------


@query("read_run_processing", "S-2", NAMES + """
SELECT readset_name, sample_name, specimen_name, project_name,
  (SELECT count(*) FROM e_readset_file f WHERE f.readset_id = n.readset_id) AS files,
  (SELECT count(*) FROM e_readset_operation o WHERE o.readset_id = n.readset_id) AS metrics
FROM named n
""")
def read_run_processing_reports(t):
    docs = read_run_processing(t["project"].sparkSession, reports.run_processing_reports(t), multi_line=False)
    rows = docs.select("project_name", F.explode("specimen").alias("p"))
    rows = rows.select("project_name", "p.specimen_name", F.explode("p.sample").alias("s"))
    rows = rows.select("project_name", "specimen_name", "s.sample_name", F.explode("s.readset").alias("r"))

    def count(col):
        return F.coalesce(F.size(F.col(col)), F.lit(0)).cast("bigint")

    return rows.select(
        "r.readset_name", "sample_name", "specimen_name", "project_name",
        F.greatest(count("r.file"), F.lit(0)).alias("files"), F.greatest(count("r.metric"), F.lit(0)).alias("metrics"),
    )


@query("read_transfer", "S-3", NAMES + """
SELECT readset_name, 'alpha:///run/' || readset_id || '/' || file_id AS src, 'bravo:///run/' || readset_id || '/' || file_id AS dest
FROM named JOIN e_readset_file USING (readset_id)
""")
def read_transfer_reports(t):
    docs = read_transfer(t["project"].sparkSession, reports.move_reports(t, "alpha", "bravo"), multi_line=False)
    rows = docs.select(F.explode("readset").alias("r")).select("r.readset_name", F.explode("r.file").alias("f"))
    return rows.select("readset_name", F.col("f.src_location_uri").alias("src"), F.col("f.dest_location_uri").alias("dest"))


@query("read_pipeline_run", "S-4", NAMES + """
SELECT readset_name, job, CASE WHEN job = 'qc' THEN NULL ELSE 'COMPLETED' END AS status FROM named,
  LATERAL (SELECT unnest(['trim.' || readset_name, 'merge', 'qc']) AS job)
""")
def read_pipeline_reports(t):
    docs = read_pipeline_run(t["project"].sparkSession, reports.pipeline_reports(t), multi_line=False)
    rows = docs.select(F.explode("sample").alias("s")).select(F.explode("s.readset").alias("r"))
    rows = rows.select("r.readset_name", F.explode("r.job").alias("j"))
    return rows.select("readset_name", F.col("j.job_name").alias("job"), F.col("j.job_status").alias("status"))


@query("read_delivery", "S-5", NAMES + """
SELECT readset_name, readset_id % 2 = 0 AS "delete", count(*) AS files FROM named JOIN e_readset_file USING (readset_id) GROUP BY ALL
""")
def read_delivery_reports(t):
    docs = read_delivery(t["project"].sparkSession, reports.move_reports(t, "bravo", "handoff", True), multi_line=False)
    rows = docs.select("delete", F.explode("readset").alias("r"))
    return rows.select("r.readset_name", "delete", F.size("r.file").cast("bigint").alias("files"))


# --- run processing -------------------------------------------------------------------------


@query("created_projects", "I-2, F-3", "SELECT upper(name) AS name, rank() OVER (ORDER BY name) AS id FROM e_project")
def created_projects(t):
    return reports.empty_with_projects(t)["project"].select("name", "id")


@query("ingested_readsets", "I-15, I-3, I-4, I-5, I-6, I-9", NAMES + """
SELECT readset_name, lane, sequencing_type, 'VALID' AS state, sample_name, tumour, specimen_name, cohort, project_name,
  nucleic_acid_type, library_kit, run_name FROM named
""")
def ingested_readsets(t):
    n = reports.loaded_runs(t)[1]
    r = n["readset"].select(F.col("name").alias("readset_name"), "lane", "sequencing_type", "state", "sample_id", "experiment_id", "run_id")
    e = n["experiment"].select(F.col("id").alias("experiment_id"), "nucleic_acid_type", "library_kit")
    s = n["sample"].select(F.col("id").alias("sample_id"), F.col("name").alias("sample_name"), "tumour", "specimen_id")
    p = n["specimen"].select(F.col("id").alias("specimen_id"), F.col("name").alias("specimen_name"), "cohort", "project_id")
    rows = r.join(e, "experiment_id").join(s, "sample_id").join(p, "specimen_id").join(_name(n, "project"), "project_id")
    return rows.join(_name(n, "run"), "run_id").select(
        "readset_name", "lane", "sequencing_type", "state", "sample_name", "tumour", "specimen_name", "cohort",
        "project_name", "nucleic_acid_type", "library_kit", "run_name",
    )


@query("ingested_entity_counts", "I-1, I-3, I-4, I-5, I-6, I-7, I-8", NAMES + """
SELECT 'experiment' AS name, count(DISTINCT (nucleic_acid_type, library_kit)) AS rows, count(DISTINCT (nucleic_acid_type, library_kit)) AS ids FROM named
UNION ALL SELECT 'file', count(*), count(*) FROM e_readset_file
UNION ALL SELECT 'job', count(DISTINCT (project_name, run_name)), count(DISTINCT (project_name, run_name)) FROM named
UNION ALL SELECT 'job_file', count(*), count(*) FROM e_readset_file
UNION ALL SELECT 'location', count(*), count(*) FROM e_readset_file
UNION ALL SELECT 'metric', count(*), count(*) FROM e_readset_operation
UNION ALL SELECT 'operation', count(DISTINCT project_name), count(DISTINCT project_name) FROM named
UNION ALL SELECT 'readset', count(*), count(*) FROM named
UNION ALL SELECT 'readset_file', count(*), count(*) FROM e_readset_file
UNION ALL SELECT 'readset_job', count(*), count(*) FROM named
UNION ALL SELECT 'readset_metric', count(*), count(*) FROM e_readset_operation
UNION ALL SELECT 'readset_operation', count(*), count(*) FROM named
UNION ALL SELECT 'run', count(DISTINCT run_name), count(DISTINCT run_name) FROM named
UNION ALL SELECT 'sample', count(DISTINCT sample_name), count(DISTINCT sample_name) FROM named
UNION ALL SELECT 'specimen', count(DISTINCT specimen_name), count(DISTINCT specimen_name) FROM named
""")
def ingested_entity_counts(t):
    """New ids are 1..n without gaps: as many distinct ids as rows, the largest being n."""
    n = reports.loaded_runs(t)[1]
    out = None
    for name in sorted(set(n) - {"project", "reference", "operation_config"}):
        ids = F.max("id") if "id" in n[name].columns else F.count(F.lit(1))
        part = n[name].agg(F.count(F.lit(1)).alias("rows"), ids.alias("ids")).select(F.lit(name).alias("name"), "rows", "ids")
        out = part if out is None else out.unionByName(part)
    return out


@query("ingested_files", "I-15, I-12, I-14", NAMES + """
SELECT readset_name, f.name AS file_name, f.type, f.md5sum, f.deliverable, f.read_type, 'alpha' AS endpoint,
  'alpha:///run/' || readset_id || '/' || file_id AS uri, run_id || '-03-04 05:06:07' AS job_start
FROM named JOIN e_readset_file USING (readset_id) JOIN e_file f ON f.id = file_id
""")
def ingested_files(t):
    n = reports.loaded_runs(t)[1]
    f = n["file"].select(
        F.col("id").alias("file_id"), F.col("name").alias("file_name"), "type", "md5sum", "deliverable",
        F.get_json_object("extra_metadata", "$.read_type").alias("read_type"),
    )
    at = n["location"].select("file_id", "endpoint", "uri")
    jobs = n["job"].select(F.col("id").alias("job_id"), F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("job_start"))
    rows = n["readset_file"].join(_name(n, "readset"), "readset_id").join(f, "file_id").join(at, "file_id")
    return rows.join(n["job_file"].join(jobs, "job_id"), "file_id").select(
        "readset_name", "file_name", "type", "md5sum", "deliverable", "read_type", "endpoint", "uri", "job_start"
    )


@query("ingested_metrics", "I-15", NAMES + """
SELECT readset_name, 'op' || operation_id AS metric_name, CAST(operation_id AS VARCHAR) AS value, 'PASS' AS flag, operation_id % 2 = 0 AS deliverable
FROM named JOIN e_readset_operation USING (readset_id)
""")
def ingested_metrics(t):
    n = reports.loaded_runs(t)[1]
    m = n["metric"].select(F.col("id").alias("metric_id"), F.col("name").alias("metric_name"), "value", "flag", "deliverable")
    return n["readset_metric"].join(m, "metric_id").join(_name(n, "readset"), "readset_id").select(
        "readset_name", "metric_name", "value", "flag", "deliverable"
    )


@query("ingested_sample_aliases", "I-4, F-9", NAMES + """
SELECT sample_name, array_to_string(list_sort(list(DISTINCT 'alias' || (readset_id % 2))), ',') AS alias FROM named GROUP BY 1
""")
def ingested_sample_aliases(t):
    n = reports.loaded_runs(t)[1]
    return n["sample"].select(F.col("name").alias("sample_name"), F.array_join(F.array_sort("alias"), ",").alias("alias"))


@query("ingest_warning_counts", "I-1, I-7, I-8", NAMES + """
SELECT 'already_exists' AS code, 'operation' AS entity, count(*) - count(DISTINCT project_name) AS n FROM named
UNION ALL SELECT 'already_exists', 'job', count(*) - count(DISTINCT (project_name, run_name)) FROM named
UNION ALL SELECT 'already_exists', 'run', count(*) - count(DISTINCT run_name) FROM named
UNION ALL SELECT 'already_exists', 'experiment', count(*) - count(DISTINCT (nucleic_acid_type, library_kit)) FROM named
""")
def ingest_warning_counts(t):
    rows = reports.loaded_runs(t)[0].warning_rows()
    return rows.groupBy("code", "entity").agg(F.count(F.lit(1)).alias("n"))


@query("reingest_rejections", "V-1, I-15", NAMES + """
SELECT 'name_taken' AS code, 'readset' AS entity, readset_name AS detail FROM named
""")
def reingest_rejections(t):
    return reports.reloaded_runs(t).errors.select("code", "entity", "detail")


# --- transfer and delivery ------------------------------------------------------------------


@query("transferred_locations", "I-16, I-12", NAMES + """
SELECT readset_name, e.endpoint, e.endpoint || ':///run/' || readset_id || '/' || file_id AS uri, e.jobs
FROM named JOIN e_readset_file USING (readset_id), (VALUES ('alpha', 2), ('bravo', 2)) e(endpoint, jobs)
""")
def transferred_locations(t):
    n = reports.loaded_transfers(t)[1]
    jobs = n["job_file"].groupBy("file_id").agg(F.count(F.lit(1)).cast("int").alias("jobs"))
    rows = n["readset_file"].join(_name(n, "readset"), "readset_id").join(n["location"].select("file_id", "endpoint", "uri"), "file_id")
    return rows.join(jobs, "file_id").select("readset_name", "endpoint", "uri", "jobs")


@query("transferred_links", "I-16, I-19", NAMES + """
SELECT project_name, op AS operation_name, count(*) AS readsets FROM named,
  LATERAL (SELECT unnest(['run_processing', 'transfer']) AS op)
WHERE op = 'run_processing' OR readset_id IN (SELECT readset_id FROM e_readset_file) GROUP BY ALL
""")
def transferred_links(t):
    n = reports.loaded_transfers(t)[1]
    ops = n["operation"].select(F.col("id").alias("operation_id"), F.col("name").alias("operation_name"), "project_id")
    rows = n["readset_operation"].join(ops, "operation_id").join(_name(n, "project"), "project_id")
    return rows.groupBy("project_name", "operation_name").agg(F.count(F.lit(1)).alias("readsets"))


@query("delivered_locations", "I-18, I-13", NAMES + """
SELECT e.endpoint || ':///run/' || readset_id || '/' || file_id AS uri, 'DELIVERED' AS state,
  e.endpoint = 'bravo' AND readset_id % 2 = 0 AS deleted
FROM named JOIN e_readset_file USING (readset_id), (VALUES ('alpha'), ('bravo'), ('handoff')) e(endpoint)
""")
def delivered_locations(t):
    n = reports.loaded_deliveries(t)[1]
    f = n["file"].select(F.col("id").alias("file_id"), "state")
    return n["location"].join(f, "file_id").select("uri", "state", "deleted")


@query("missing_transfer_sources", "V-4", NAMES + """
SELECT readset_name, 'alpha:///d/' || f.id || '/' || f.name AS src_uri FROM named JOIN e_readset_file USING (readset_id) JOIN e_file f ON f.id = file_id
WHERE f.id NOT IN (SELECT file_id FROM e_location)
""")
def missing_transfer_sources(t):
    names = t["readset"].select(F.col("id").alias("readset_id"), F.col("name").alias("readset_name"))
    f = t["file"].select(F.col("id").alias("file_id"), "name")
    asked = t["readset_file"].join(names, "readset_id").join(f, "file_id").select(
        "readset_name", F.concat(F.lit("alpha:///d/"), "file_id", F.lit("/"), "name").alias("src_uri")
    )
    return v.missing_source_files(t, asked).select("readset_name", "src_uri")


# --- pipeline runs --------------------------------------------------------------------------

# The shared job of each project, its readsets in document order, and the stretches of equal values.
RUNS = NAMES + """, step AS (
  SELECT project_name, readset_id, CAST(readset_id // 50 AS VARCHAR) AS era,
    coalesce(lag(readset_id // 50) OVER w <> readset_id // 50, true) AS fresh
  FROM named WINDOW w AS (PARTITION BY project_name ORDER BY readset_id)),
run AS (
  SELECT *, CAST(sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY project_name ORDER BY readset_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM step),
version AS (
  SELECT project_name, run, any_value(era) AS value, count(*) AS readsets,
    run < max(run) OVER (PARTITION BY project_name) AS deprecated FROM run GROUP BY project_name, run)
"""


@query("pipeline_metric_versions", "I-17, I-10", RUNS + "SELECT project_name, value, deprecated, readsets FROM version")
def pipeline_metric_versions(t):
    n = reports.loaded_pipelines(t)[1]
    m = n["metric"].filter("name = 'merged'").select(F.col("id").alias("metric_id"), "job_id", "value", "deprecated")
    links = n["readset_metric"].groupBy("metric_id").agg(F.count(F.lit(1)).alias("readsets"))
    j = n["job"].select(F.col("id").alias("job_id"), "operation_id")
    o = n["operation"].select(F.col("id").alias("operation_id"), "project_id")
    rows = m.join(_grown(links), "metric_id").join(_grown(j), "job_id").join(o, "operation_id").join(_name(n, "project"), "project_id")
    return rows.select("project_name", "value", "deprecated", "readsets")


@query("pipeline_file_versions", "I-17, I-11", RUNS + """
SELECT project_name, md5(value) AS md5sum, deprecated, readsets FROM version
""")
def pipeline_file_versions(t):
    n = reports.loaded_pipelines(t)[1]
    f = n["file"].filter("name = 'summary.txt'").select(F.col("id").alias("file_id"), "md5sum", "deprecated")
    links = n["readset_file"].groupBy("file_id").agg(F.count(F.lit(1)).alias("readsets"))
    j = n["job"].select(F.col("id").alias("job_id"), "operation_id")
    o = n["operation"].select(F.col("id").alias("operation_id"), "project_id")
    rows = f.join(_grown(links), "file_id").join(_grown(n["job_file"]), "file_id").join(_grown(j), "job_id").join(o, "operation_id")
    return rows.join(_name(n, "project"), "project_id").select("project_name", "md5sum", "deprecated", "readsets")


@query("pipeline_own_files", "I-17, I-14", NAMES + """
SELECT readset_name, 'trim.' || readset_name AS job_name, readset_name || '.trim.fastq.gz' AS file_name, 'trim.fastq.gz' AS wide,
  'fastq.gz' AS type, 'alpha:///trim/' || readset_name AS uri, CAST(readset_id AS VARCHAR) AS reads FROM named
""")
def pipeline_own_files(t):
    n = reports.loaded_pipelines(t)[1]
    j = n["job"].filter(F.col("name").startswith("trim.")).select(F.col("id").alias("job_id"), F.col("name").alias("job_name"))
    f = n["file"].select(F.col("id").alias("file_id"), F.col("name").alias("file_name"), "type")
    m = n["metric"].filter("name = 'reads'").select("job_id", F.col("value").alias("reads"))
    rows = n["job_file"].join(_grown(j), "job_id").join(_grown(f), "file_id").join(_grown(n["location"].select("file_id", "uri")), "file_id")
    rows = rows.join(_grown(n["readset_job"]), "job_id").join(_grown(_name(n, "readset")), "readset_id").join(_grown(m), "job_id")
    return rows.select(
        "readset_name", "job_name", "file_name", F.concat(F.lit("trim."), "type").alias("wide"), "type", "uri", "reads"
    )


@query("pipeline_shared_location", "I-13, I-12", RUNS + """
SELECT 'alpha:///merge/summary.txt' AS uri, md5(CAST(max(readset_id) // 50 AS VARCHAR)) AS md5sum FROM named
""")
def pipeline_shared_location(t):
    """One uri met under many files ends with the file of its last document."""
    n = reports.loaded_pipelines(t)[1]
    f = n["file"].select(F.col("id").alias("file_id"), "md5sum")
    return n["location"].filter(F.col("uri").startswith("alpha:///merge/")).join(_grown(f), "file_id").select("uri", "md5sum")


@query("pipeline_warning_counts", "I-17, I-1", RUNS + """
SELECT 'already_exists' AS code, 'operation_config' AS entity, count(*) - 1 AS n FROM named
UNION ALL SELECT 'already_exists', 'operation', count(*) - count(DISTINCT project_name) FROM named
UNION ALL SELECT 'already_exists', 'job', count(*) - count(DISTINCT project_name) FROM named
UNION ALL SELECT 'already_exists', 'location', count(*) - 1 FROM named
UNION ALL SELECT 'job_without_status', 'readset', count(*) FROM named
UNION ALL SELECT 'replaced', 'metric', count(*) - count(DISTINCT project_name) FROM version
UNION ALL SELECT 'replaced', 'file', count(*) - count(DISTINCT project_name) FROM version
""")
def pipeline_warning_counts(t):
    rows = reports.loaded_pipelines(t)[0].warning_rows()
    return rows.groupBy("code", "entity").agg(F.count(F.lit(1)).alias("n"))


@query("pipeline_reload_counts", "I-17, I-1, I-19", NAMES + """
SELECT n AS name, b AS before, b AS after FROM (
  SELECT 'job' AS n, count(*) + count(DISTINCT project_name) + count(DISTINCT (project_name, run_name)) AS b FROM named
  UNION ALL SELECT 'operation', 2 * count(DISTINCT project_name) FROM named
  UNION ALL SELECT 'operation_config', 1
  UNION ALL SELECT 'location', (SELECT count(*) FROM e_readset_file) + count(*) + 1 FROM named
  UNION ALL SELECT 'readset_job', 3 * count(*) FROM named
  UNION ALL SELECT 'readset_operation', 2 * count(*) FROM named)
""")
def pipeline_reload_counts(t):
    """Loading the same reports twice adds no job, operation, config, location or job link."""
    before, after = reports.loaded_pipelines(t)[1], reports.reloaded_pipelines(t)[1]
    out = None
    for name in ("job", "operation", "operation_config", "location", "readset_job", "readset_operation"):
        b = before[name].agg(F.count(F.lit(1)).alias("before")).select(F.lit(name).alias("name"), "before")
        part = b.join(after[name].agg(F.count(F.lit(1)).alias("after")).select(F.lit(name).alias("name"), "after"), "name")
        out = part if out is None else out.unionByName(part)
    return out


# --- checks ---------------------------------------------------------------------------------


@query("taken_readset_names", "V-1", "SELECT name, id % 3 AS doc FROM e_readset WHERE id % 2 = 0")
def taken_readset_names(t):
    asked = t["readset"].select(
        F.when(F.col("id") % 2 == 0, F.col("name")).otherwise(F.concat(F.lit("new"), "name")).alias("name"),
        (F.col("id") % 3).alias("doc"),
    )
    return v.existing_names(t, asked).select("name", "doc")


@query("repeated_batch_names", "V-1", """
, asked AS (SELECT 'B' || (id % 700) AS name, id // 300 AS doc FROM e_readset),
per AS (SELECT name, doc, count(*) AS n FROM asked GROUP BY ALL)
SELECT name, doc FROM per p WHERE n > 1 OR doc > (SELECT min(doc) FROM per q WHERE q.name = p.name)
""")
def repeated_batch_names(t):
    asked = t["readset"].select(
        F.concat(F.lit("B"), F.col("id") % 700).alias("name"), F.floor(F.col("id") / 300).cast("bigint").alias("doc")
    )
    return v.repeated_names(asked)


@query("enum_violations", "V-2", "SELECT id, flag FROM e_metric WHERE flag NOT IN ('PASS', 'WARNING', 'FAILED')")
def enum_violations(t):
    return v.enum_violations(t["metric"], "flag", ("PASS", "WARNING", "FAILED")).select("id", "flag")


@query("pipeline_reference_errors", "V-3", """
, asked AS (
  SELECT r.id AS doc, CASE WHEN r.id % 5 = 0 THEN 'nobody' ELSE s.name END AS sample_name,
    CASE WHEN r.id % 7 = 1 THEN 'nothing' WHEN r.id % 7 = 2 THEN 'RS1' ELSE r.name END AS readset_name
  FROM e_readset r JOIN e_sample s ON s.id = r.sample_id)
SELECT DISTINCT doc, code, CASE WHEN code = 'sample_missing' THEN 'sample' ELSE 'readset' END AS entity,
  CASE WHEN code = 'sample_missing' THEN sample_name ELSE readset_name END AS detail FROM (
  SELECT a.*, CASE WHEN s.id IS NULL THEN 'sample_missing' WHEN r.id IS NULL THEN 'readset_missing'
    WHEN r.sample_id <> s.id THEN 'readset_of_other_sample' END AS code
  FROM asked a LEFT JOIN e_sample s ON s.name = a.sample_name AND NOT s.deprecated AND NOT s.deleted
  LEFT JOIN e_readset r ON r.name = a.readset_name AND NOT r.deprecated AND NOT r.deleted) WHERE code IS NOT NULL
""")
def pipeline_reference_errors(t):
    s = t["sample"].select(F.col("id").alias("sample_id"), F.col("name").alias("_sample"))
    asked = t["readset"].join(s, "sample_id").select(
        F.col("id").alias("doc"),
        F.when(F.col("id") % 5 == 0, "nobody").otherwise(F.col("_sample")).alias("sample_name"),
        F.when(F.col("id") % 7 == 1, "nothing").when(F.col("id") % 7 == 2, "RS1").otherwise(F.col("name")).alias("readset_name"),
    )
    return v.pipeline_ref_errors(t, asked)


@query("empty_documents", "V-5", """
SELECT id AS doc, CASE WHEN id % 4 = 0 THEN 'no_sample' ELSE 'no_job_status' END AS code, 'document' AS entity,
  CAST(NULL AS VARCHAR) AS detail FROM e_readset WHERE id % 4 IN (0, 1)
""")
def empty_documents(t):
    status = F.when(F.col("id") % 4 != 1, "COMPLETED")
    sample = F.array(F.struct(F.array(F.struct(F.array(F.struct(status.alias("job_status"))).alias("job"))).alias("readset")))
    docs = t["readset"].select(F.col("id").alias("doc"), F.when(F.col("id") % 4 != 0, sample).alias("sample"))
    return v.empty_documents(docs)


@query("unique_violations", "V-6", """
SELECT md5sum AS value, count(*) AS rows FROM e_file WHERE md5sum IS NOT NULL GROUP BY 1 HAVING count(*) > 1
""")
def unique_violations(t):
    return v.unique_violations(t["file"], "md5sum")


@query("missing_ids", "V-7", "SELECT DISTINCT job_id + 40 AS id FROM e_metric WHERE job_id + 40 NOT IN (SELECT id FROM e_job)")
def missing_ids(t):
    return v.missing_ids(t, "job", t["metric"].select((F.col("job_id") + 40).alias("id")))
