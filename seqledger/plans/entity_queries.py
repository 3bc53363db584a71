"""Table catalog, entity queries, related ids and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import (
    after_scheme,
    as_text,
    before_triple_slash,
    bytes_md5,
    date_or,
    file_type,
    first_of,
    id_ranges,
    invalid_id_tokens,
    json_field,
    name_list,
    text_bytes,
    topup_base,
    topup_number,
    topup_type,
    is_topup,
    union_alias,
    upper_name,
)
from ..operators import entities as q
from ..operators import related as p
from ..schemas import LONG_DATE, SCHEMAS
from .registry import query
from .views import topup_samples

# The reference path of a file or metric: readset, sample, specimen, project.
REACH = """, path AS (
  SELECT r.id AS readset_id, s.id AS sample_id, p.id AS specimen_id, p.project_id
  FROM e_readset r JOIN e_sample s ON r.sample_id = s.id JOIN e_specimen p ON s.specimen_id = p.id
  JOIN e_project j ON p.project_id = j.id)
"""

FILE_COLS = ("id", "name", "type", "md5sum", "deliverable", "state")
FILE_SQL = "f.id, f.name, f.type, f.md5sum, f.deliverable, f.state"
METRIC_COLS = ("id", "name", "job_id", "value", "flag", "deliverable", "aggregate")
METRIC_SQL = "m.id, m.name, m.job_id, m.value, m.flag, m.deliverable, m.aggregate"
READSET_COLS = ("id", "name", "sample_id", "experiment_id", "run_id", "lane", "state")
READSET_SQL = ", ".join(f"r.{c}" for c in READSET_COLS)


@query("table_catalog", "S-1", """
SELECT 'project' AS name, count(*) AS n FROM e_project UNION ALL SELECT 'specimen', count(*) FROM e_specimen
UNION ALL SELECT 'sample', count(*) FROM e_sample UNION ALL SELECT 'experiment', count(*) FROM e_experiment
UNION ALL SELECT 'run', count(*) FROM e_run UNION ALL SELECT 'readset', count(*) FROM e_readset
UNION ALL SELECT 'operation', count(*) FROM e_operation UNION ALL SELECT 'reference', 0
UNION ALL SELECT 'operation_config', count(*) FROM e_operation_config UNION ALL SELECT 'job', count(*) FROM e_job
UNION ALL SELECT 'metric', count(*) FROM e_metric UNION ALL SELECT 'file', count(*) FROM e_file
UNION ALL SELECT 'location', count(*) FROM e_location UNION ALL SELECT 'readset_file', count(*) FROM e_readset_file
UNION ALL SELECT 'readset_metric', count(*) FROM e_readset_metric
UNION ALL SELECT 'readset_job', count(*) FROM e_readset_job
UNION ALL SELECT 'readset_operation', count(*) FROM e_readset_operation
UNION ALL SELECT 'job_file', count(*) FROM e_job_file
""")
def table_catalog(t):
    parts = [t[n].agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in SCHEMAS]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


# --- entity queries -------------------------------------------------------------------------


@query("projects_all", "Q-1", "SELECT id, name FROM e_project WHERE NOT deprecated AND NOT deleted")
def projects_all(t):
    return q.projects(t).select("id", "name")


@query("projects_by_id", "Q-1, F-1", "SELECT id, name FROM e_project WHERE id IN (0, 2, 3, 4)")
def projects_by_id(t):
    return q.projects(t, [0, 2, 3, 4]).select("id", "name")


@query("metrics_project", "Q-2", REACH + f"""
SELECT {METRIC_SQL} FROM e_metric m WHERE NOT m.deprecated AND NOT m.deleted AND m.id IN (
  SELECT metric_id FROM e_readset_metric JOIN path USING (readset_id) WHERE project_id IN (1, 2))
""")
def metrics_project(t):
    return q.metrics(t, [1, 2]).select(*METRIC_COLS)


@query("metrics_deliverable_by_specimen", "Q-2", REACH + f"""
SELECT {METRIC_SQL} FROM e_metric m WHERE m.deliverable AND m.id IN (
  SELECT metric_id FROM e_readset_metric JOIN path USING (readset_id)
  WHERE project_id IN (0, 1, 2, 3, 4) AND specimen_id IN (3, 5, 8, 13, 21))
""")
def metrics_deliverable_by_specimen(t):
    # The sample filter does not apply beside a specimen filter.
    return q.metrics(t, range(5), True, specimen_id=[3, 5, 8, 13, 21], sample_id=[1]).select(*METRIC_COLS)


@query("files_deliverable", "Q-3", REACH + f"""
SELECT {FILE_SQL} FROM e_file f WHERE f.deliverable AND NOT f.deprecated AND NOT f.deleted AND f.id IN (
  SELECT file_id FROM e_readset_file JOIN path USING (readset_id) WHERE project_id = 1)
""")
def files_deliverable(t):
    return q.files(t, 1, deliverable=True).select(*FILE_COLS)


@query("files_state_by_sample", "Q-3", REACH + f"""
SELECT {FILE_SQL} FROM e_file f WHERE f.state = 'VALID' AND f.id IN (
  SELECT file_id FROM e_readset_file JOIN path USING (readset_id)
  WHERE project_id IN (0, 1, 2) AND sample_id IN (7, 21, 33, 64, 70))
""")
def files_state_by_sample(t):
    return q.files(t, [0, 1, 2], sample_id=[7, 21, 33, 64, 70], state="VALID").select(*FILE_COLS)


@query("files_by_id", "Q-3", REACH + f"""
SELECT {FILE_SQL} FROM e_file f WHERE f.id IN (11, 12, 13, 14, 15, 20) AND f.id IN (
  SELECT file_id FROM e_readset_file JOIN path USING (readset_id) WHERE project_id IN (0, 1))
""")
def files_by_id(t):
    return q.files(t, [0, 1], file_id=[11, 12, 13, 14, 15, 20], specimen_id=3).select(*FILE_COLS)


@query("operations_project", "Q-4", """
SELECT id, name, operation_config_id, status FROM e_operation WHERE project_id IN (0, 3)
""")
def operations_project(t):
    return q.operations(t, [0, 3]).select("id", "name", "operation_config_id", "status")


@query("operations_by_readset", "Q-4", """
SELECT id, name, operation_config_id, status FROM e_operation WHERE project_id IN (0, 1, 2, 3, 4)
  AND id IN (SELECT operation_id FROM e_readset_operation WHERE readset_id IN (1, 2, 3, 5, 8, 13))
""")
def operations_by_readset(t):
    rows = q.operations(t, range(5), readset_id=[1, 2, 3, 5, 8, 13])
    return rows.select("id", "name", "operation_config_id", "status")


@query("jobs_project", "Q-5", """
SELECT id, name, operation_id FROM e_job WHERE operation_id IN (SELECT id FROM e_operation WHERE project_id IN (1, 4))
""")
def jobs_project(t):
    return q.jobs(t, [1, 4]).select("id", "name", "operation_id")


@query("jobs_by_readset", "Q-5", """
SELECT id, name, operation_id FROM e_job WHERE operation_id IN (SELECT id FROM e_operation)
  AND id IN (SELECT job_id FROM e_readset_job WHERE readset_id IN (1, 2, 3, 5, 8, 13, 21))
""")
def jobs_by_readset(t):
    return q.jobs(t, range(5), readset_id=[1, 2, 3, 5, 8, 13, 21]).select("id", "name", "operation_id")


@query("readsets_project", "Q-6", REACH + f"""
SELECT {READSET_SQL} FROM e_readset r WHERE NOT r.deprecated AND NOT r.deleted
  AND r.id IN (SELECT readset_id FROM path WHERE project_id IN (2, 3))
""")
def readsets_project(t):
    return q.readsets(t, [2, 3]).select(*READSET_COLS)


@query("readsets_deleted_by_specimen", "Q-6", REACH + f"""
SELECT {READSET_SQL} FROM e_readset r WHERE NOT r.deprecated AND r.deleted
  AND r.id IN (SELECT readset_id FROM path WHERE specimen_id IN (1, 2, 3, 4))
""")
def readsets_deleted_by_specimen(t):
    return q.readsets(t, range(5), specimen_id=[1, 2, 3, 4], deleted=True).select(*READSET_COLS)


@query("specimens_by_readset", "Q-7", REACH + """
SELECT id, name, cohort FROM e_specimen WHERE id IN (SELECT specimen_id FROM path WHERE readset_id IN (4, 9, 16, 25, 36))
""")
def specimens_by_readset(t):
    return q.specimens(t, range(5), readset_id=[4, 9, 16, 25, 36]).select("id", "name", "cohort")


@query("samples_tumour", "Q-8", """
SELECT s.id, s.name, s.tumour FROM e_sample s JOIN e_specimen p ON s.specimen_id = p.id
WHERE p.project_id IN (0, 1) AND s.tumour AND NOT s.deprecated AND NOT s.deleted
""")
def samples_tumour(t):
    return q.samples(t, [0, 1], tumour=True).select("id", "name", "tumour")


@query("samples_by_readset", "Q-8", """
SELECT id, name, tumour FROM e_sample WHERE NOT deprecated AND NOT deleted
  AND id IN (SELECT sample_id FROM e_readset WHERE id IN (4, 9, 16, 25, 36, 49))
""")
def samples_by_readset(t):
    return q.samples(t, range(5), readset_id=[4, 9, 16, 25, 36, 49]).select("id", "name", "tumour")


@query("samples_pair", "Q-9", """
SELECT s.id, s.name FROM e_sample s JOIN e_specimen p ON s.specimen_id = p.id
WHERE NOT s.deprecated AND NOT s.deleted AND p.project_id IN (0, 2) AND EXISTS (
  SELECT 1 FROM e_readset r JOIN e_experiment e ON r.experiment_id = e.id
  WHERE r.sample_id = s.id AND e.nucleic_acid_type = 'DNA')
""")
def samples_pair(t):
    return q.samples_pair(t, [0, 2], pair=True).select("id", "name")


@query("name_lookup_exact", "Q-10", "SELECT id FROM e_readset WHERE name IN ('RS7', 'RS70', 'RS77', 'none')")
def name_lookup_exact(t):
    return q.name_to_id(t, "readset", ["RS7", "RS70", "RS77", "none"])


@query("name_lookup_table", "Q-10", "SELECT id FROM e_file WHERE name IN (SELECT name FROM e_file WHERE deliverable)")
def name_lookup_table(t):
    return q.names_found(t, "file", t["file"].filter("deliverable"))


@query("name_lookup_pattern", "Q-11", """
SELECT id FROM e_readset WHERE regexp_matches(name, '^RS1[0-3]+$') OR contains(name, 'RS99')
""")
def name_lookup_pattern(t):
    return q.name_to_id(t, "readset", ["r:^RS1[0-3]+$", "RS99"])


@query("files_by_sample_names", "Q-12", REACH + f"""
SELECT {FILE_SQL} FROM e_file f WHERE f.id IN (
  SELECT file_id FROM e_readset_file JOIN path USING (readset_id) JOIN e_sample s ON s.id = sample_id
  WHERE project_id IN (0, 1, 2, 3, 4) AND regexp_matches(s.name, '00000[0-4]$'))
""")
def files_by_sample_names(t):
    by = {"sample": "r:00000[0-4]$", "readset": ["RS1"]}
    return q.query_by_names(t, "file", range(5), by).select(*FILE_COLS)


@query("metrics_by_readset_names", "Q-12", REACH + f"""
SELECT {METRIC_SQL} FROM e_metric m WHERE m.id IN (
  SELECT metric_id FROM e_readset_metric JOIN path USING (readset_id) WHERE readset_id IN (3, 14, 15, 92))
""")
def metrics_by_readset_names(t):
    by = {"readset": ["RS3", "RS14", "RS15", "RS92"]}
    return q.query_by_names(t, "metric", range(5), by).select(*METRIC_COLS)


@query("operations_by_readset_names", "Q-12", """
SELECT id, name FROM e_operation WHERE id IN (
  SELECT operation_id FROM e_readset_operation JOIN e_readset r ON r.id = readset_id WHERE r.name IN ('RS3', 'RS14', 'RS15'))
""")
def operations_by_readset_names(t):
    return q.query_by_names(t, "operation", range(5), {"readset": ["RS3", "RS14", "RS15"]}).select("id", "name")


@query("specimens_by_sample_names", "Q-12", """
SELECT id, name FROM e_specimen WHERE id IN (
  SELECT specimen_id FROM e_sample WHERE name IN ('Customer#000000004', 'Customer#000000009'))
""")
def specimens_by_sample_names(t):
    by = {"sample": ["Customer#000000004", "Customer#000000009"]}
    return q.query_by_names(t, "specimen", range(5), by).select("id", "name")


@query("no_match_report", "Q-13", """
SELECT 'no_match' AS code, 'file' AS entity, CAST(NULL AS BIGINT) AS entity_id, 'project_id=99' AS detail
WHERE NOT EXISTS (SELECT 1 FROM e_file JOIN e_readset_file ON e_file.id = file_id
  JOIN e_readset r ON r.id = readset_id JOIN e_sample s ON s.id = r.sample_id
  JOIN e_specimen p ON p.id = s.specimen_id WHERE p.project_id = 99)
""")
def no_match_report(t):
    return q.no_match(q.files(t, 99), "file", project_id=99)


# --- related ids ----------------------------------------------------------------------------

SEEN = "(NOT deprecated OR NOT deleted)"


def _text(kind: str):
    """An array of ids as text, nulls written out."""
    return F.array_join(F.transform(kind, lambda x: x.cast("string")), ",", "null").alias(kind)


def _list_sql(col: str) -> str:
    return f"coalesce(array_to_string(list_sort(list(DISTINCT {col}) FILTER (WHERE {col} IS NOT NULL)), ','), '')"


@query("specimen_sample_ids", "P-1", f"""
SELECT specimen_id AS id, 'sample' AS kind, id AS related_id FROM e_sample WHERE {SEEN}
""")
def specimen_sample_ids(t):
    return p.related_ids(t, "specimen", ("sample_id",))


@query("specimen_readset_ids", "P-2", f"""
SELECT specimen_id AS id, 'sample' AS kind, id AS related_id FROM e_sample WHERE {SEEN}
UNION ALL
SELECT s.specimen_id, 'readset', r.id FROM e_sample s JOIN e_readset r ON r.sample_id = s.id WHERE NOT (r.deprecated AND r.deleted)
""")
def specimen_readset_ids(t):
    return p.related_ids(t, "specimen")


SHOWN = "CASE WHEN NOT (r.deprecated AND r.deleted) THEN r.id END"


def _linked(entity: str) -> str:
    """Linked readsets, hidden ones as nulls."""
    return f"""
SELECT l.{entity}_id AS id, 'readset' AS kind, {SHOWN} AS related_id
FROM e_readset_{entity} l JOIN e_readset r ON r.id = l.readset_id
"""


@query("sample_readset_ids", "P-3", f"SELECT r.sample_id AS id, 'readset' AS kind, {SHOWN} AS related_id FROM e_readset r")
def sample_readset_ids(t):
    return p.related_ids(t, "sample")


@query("readset_specimen_id", "P-4", """
SELECT r.id, CASE WHEN NOT (p.deprecated AND p.deleted) THEN p.id END AS specimen_id
FROM e_readset r LEFT JOIN e_sample s ON r.sample_id = s.id LEFT JOIN e_specimen p ON s.specimen_id = p.id
""")
def readset_specimen_id(t):
    return p.with_specimen_id(t).select("id", "specimen_id")


@query("operation_readset_ids", "P-5", _linked("operation"))
def operation_readset_ids(t):
    return p.related_ids(t, "operation")


@query("job_readset_ids", "P-6", _linked("job"))
def job_readset_ids(t):
    return p.related_ids(t, "job")


@query("job_readset_links", "P-6", """
SELECT l.job_id AS id, l.readset_id FROM e_readset_job l JOIN e_readset r ON r.id = l.readset_id
""")
def job_readset_links(t):
    return p.job_readset_links(t)


def _three(entity: str) -> str:
    return f"""
, up AS (
  SELECT l.{entity}_id AS id, r.id AS readset, r.deprecated AND r.deleted AS r_hidden, s.id AS sample, s.deprecated AND s.deleted AS s_hidden,
    p.id AS specimen, p.deprecated AND p.deleted AS p_hidden
  FROM e_readset_{entity} l JOIN e_readset r ON r.id = l.readset_id
  LEFT JOIN e_sample s ON s.id = r.sample_id LEFT JOIN e_specimen p ON p.id = s.specimen_id)
SELECT id, 'readset' AS kind, readset AS related_id FROM up WHERE NOT r_hidden
UNION SELECT id, 'sample', sample FROM up WHERE NOT s_hidden
UNION SELECT id, 'specimen', specimen FROM up WHERE NOT p_hidden
"""


@query("metric_related_ids", "P-7", _three("metric"))
def metric_related_ids(t):
    return p.related_ids(t, "metric")


@query("file_related_ids", "P-8", _three("file"))
def file_related_ids(t):
    return p.related_ids(t, "file")


@query("files_with_related_ids", "P-8, Q-3", REACH + f"""
SELECT f.id, f.name, {_list_sql('l.readset_id')} AS readset_ids
FROM e_file f JOIN e_readset_file l ON l.file_id = f.id JOIN (SELECT * FROM e_readset WHERE {SEEN}) r ON r.id = l.readset_id
WHERE f.deliverable AND f.id IN (SELECT file_id FROM e_readset_file JOIN path USING (readset_id) WHERE project_id = 1)
GROUP BY f.id, f.name
""")
def files_with_related_ids(t):
    rows = q.files(t, 1, deliverable=True)
    return p.with_related(t, "file", rows, ("readset_id",)).select("id", "name", _text("readset_ids"))


@query("serialized_locations", "P-9", """
SELECT id, file_id, uri, endpoint, deleted, 'location' AS tablename FROM e_location
""")
def serialized_locations(t):
    return p.serialize(t["location"], "location").select("id", "file_id", "uri", "endpoint", "deleted", "tablename")


@query("serialized_json", "P-9", """
SELECT id, '{"id":' || id || ',"name":"' || name || '","tablename":"specimen","project_id":' || project_id || '}' AS json
FROM e_specimen
""")
def serialized_json(t):
    text = p.serialize_json(t["specimen"], "specimen")
    kept = "struct<id:bigint,name:string,tablename:string,project_id:bigint>"
    return text.select("id", F.to_json(F.from_json("json", kept)).alias("json"))


# --- scalar functions -----------------------------------------------------------------------


@query("id_range_expressions", "F-1", """
SELECT id, array_to_string(list_concat([id % 100], list_concat(range(least(id % 7, 5), greatest(id % 7, 5) + 1), [9])), ',') AS ids,
  CASE WHEN id % 3 = 0 THEN 'x1' WHEN id % 3 = 1 THEN '1-2-3' ELSE '' END AS bad
FROM e_readset
""")
def id_range_expressions(t):
    good = F.concat_ws(",", (F.col("id") % 100).cast("string"), F.concat_ws("-", F.lit("5"), (F.col("id") % 7).cast("string")), F.lit("9"))
    broken = F.when(F.col("id") % 3 == 0, "4,x1").when(F.col("id") % 3 == 1, "1-2-3,6").otherwise("7,8")
    return t["readset"].select(
        "id", F.array_join(F.transform(id_ranges(good), lambda x: x.cast("string")), ",").alias("ids"),
        F.array_join(invalid_id_tokens(broken), ",").alias("bad"),
    )


@query("comma_lists", "F-2", """
SELECT id, name || '|' || type AS names, CAST(2 AS INTEGER) AS n FROM e_file
""")
def comma_lists(t):
    names = name_list(F.concat_ws(" , ", "name", F.lit(""), "type", F.lit(" ")))
    return t["file"].select("id", F.array_join(names, "|").alias("names"), F.size(names).alias("n"))


@query("scalar_text", "F-3, F-5, F-7, F-8, F-12", """
SELECT id, upper(endpoint) AS up, regexp_replace(uri, '[0-9]+/', '#/', 'g') AS masked,
  regexp_extract(uri, '/d/([0-9]+)/', 1) AS number, replace(uri, 'alpha', 'ab') AS short,
  starts_with(uri, 'bravo') AS starts, ends_with(uri, '.bam') AS ends,
  split_part(uri, ':///', 1) AS before, split_part(uri, '://', 2) AS after, split_part(uri, '/', 6) AS leaf
FROM e_location
""")
def scalar_text(t):
    uri = F.col("uri")
    return t["location"].select(
        "id", upper_name(F.col("endpoint")).alias("up"), F.regexp_replace(uri, "[0-9]+/", "#/").alias("masked"),
        F.regexp_extract(uri, "/d/([0-9]+)/", 1).alias("number"),
        F.replace(uri, F.lit("alpha"), F.lit("ab")).alias("short"),
        uri.startswith("bravo").alias("starts"), uri.endswith(".bam").alias("ends"),
        before_triple_slash(uri).alias("before"), after_scheme(uri).alias("after"),
        first_of(F.slice(F.split(uri, "/"), -1, 1)).alias("leaf"),
    )


@query("scalar_bytes", "F-4, F-11", """
SELECT id, md5(name) AS digest, name AS text FROM e_readset
""")
def scalar_bytes(t):
    raw = text_bytes(F.col("name"))
    return t["readset"].select("id", bytes_md5(raw).alias("digest"), as_text(raw).alias("text"))


@query("scalar_ilike", "F-6", "SELECT id, name FROM e_operation WHERE name NOT ILIKE '%PIPES%'")
def scalar_ilike(t):
    return t["operation"].filter(~F.col("name").ilike("%PIPES%")).select("id", "name")


@query("scalar_json_alias", "F-9", """
SELECT id, read_type, CASE WHEN id % 2 = 0 THEN 'a,b,c' ELSE 'b,c' END AS alias, id % 2 = 0 AS has_a FROM e_file
""")
def scalar_json_alias(t):
    current = F.when(F.col("id") % 2 == 0, F.array(F.lit("a"), F.lit("b")))
    merged = union_alias(current, F.array(F.lit("b"), F.lit("c")))
    return t["file"].select(
        "id", json_field(F.col("extra_metadata"), "read_type").alias("read_type"),
        F.array_join(merged, ",").alias("alias"), F.array_contains(merged, "a").alias("has_a"),
    )


@query("scalar_dates", "F-10", """
SELECT id, CASE WHEN id % 5 = 0 THEN '2020-01-01 00:00:00' ELSE run_id || '-02-03 04:05:06' END AS at FROM e_readset
""")
def scalar_dates(t):
    given = F.when(F.col("id") % 5 != 0, F.concat(F.col("run_id"), F.lit("-02-03 04:05:06")))
    stamp = date_or(given, LONG_DATE, F.lit("2020-01-01 00:00:00").cast("timestamp"))
    return t["readset"].select("id", F.date_format(stamp, LONG_DATE).alias("at"))


@query("topup_name_parts", "C-6", r"""
SELECT id, regexp_replace(name, '-[0-9]+(RT|DT|DN|FRT)$', '') AS base,
  CAST(regexp_extract(name, '-([0-9]+)(RT|DT|DN|FRT)$', 1) AS BIGINT) AS num,
  regexp_extract(name, '-([0-9]+)(RT|DT|DN|FRT)$', 2) AS type
FROM e_topup
""")
def topup_name_parts(t):
    name = F.col("name")
    return topup_samples(t["sample"]).filter(is_topup(name)).select(
        "id", topup_base(name).alias("base"), topup_number(name).alias("num"), topup_type(name).alias("type")
    )


@query("file_types", "I-14", """
SELECT id, type, type || '.md5' AS with_md5, CASE WHEN type = 'fastq.gz' THEN 'gz' ELSE 'txt' END AS odd FROM e_file
""")
def file_types(t):
    # A first .gz keeps only the last suffix: "x.gz.txt" is "txt", "x.gz" is "gz".
    odd = F.when(F.col("id") % 4 == 1, "x.gz").otherwise("x.gz.txt")
    twice = F.concat(F.lit("a."), F.col("name"), F.lit(".md5"))
    plain = file_type(twice)
    return t["file"].select(
        "id", file_type(F.concat(F.lit("a.b."), "name")).alias("type"),
        F.when(F.col("id") % 4 == 1, plain).otherwise(F.concat(file_type(F.col("name")), F.lit(".md5"))).alias("with_md5"),
        file_type(odd).alias("odd"),
    )
