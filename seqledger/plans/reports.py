"""Reports nested from the derived tables, written as JSON lines and read back.

One document per readset, so documents stay small however large the tables are.  The files
go below the folder the cluster shares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.entities import Tables
from ..operators.ingest import (
    Loaded,
    create_project,
    ingest_delivery,
    ingest_pipeline_run,
    ingest_run_processing,
    ingest_transfer,
)
from ..session import cut, scratch_path
from ..sources.envelopes import ENVELOPE_SCHEMAS
from ..sources.tables import empty_tables

AS_OF = "2024-06-01 12:00:00"
RUN_DATE = "-03-04 05:06:07"


def write_reports(rows: DataFrame, fields: list) -> str:
    """Write one JSON line per row, compressed; ``source`` orders the documents."""
    path = scratch_path(rows.sparkSession, "reports")
    rows.select(F.to_json(F.struct(*fields, "source"))).write.text(path, compression="gzip")
    return path


def read_reports(spark, path: str, kind: str) -> DataFrame:
    return spark.read.schema(f"{ENVELOPE_SCHEMAS[kind]}, source string").json(path)


def _readsets(t: Tables) -> DataFrame:
    """Readsets with the names of everything above them. Samples are merged, as files are below:
    they grow with the data, and the size of their files says little of their rows."""
    r = t["readset"].select(
        F.col("id").alias("readset_id"), F.col("name").alias("readset_name"), "sample_id", "experiment_id",
        "run_id", "lane", "adapter1", "adapter2", "sequencing_type",
    )
    s = t["sample"].select(
        F.col("id").alias("sample_id"), F.col("name").alias("sample_name"), "tumour", "specimen_id"
    ).hint("merge")
    p = t["specimen"].select(
        F.col("id").alias("specimen_id"), F.col("name").alias("specimen_name"), "cohort", "project_id"
    )
    j = t["project"].select(F.col("id").alias("project_id"), F.col("name").alias("project_name"))
    u = t["run"].select(F.col("id").alias("run_id"), F.col("name").alias("run_name"))
    e = t["experiment"].select(F.col("id").alias("experiment_id"), "nucleic_acid_type", "library_kit")
    return (
        r.join(s, "sample_id").join(p, "specimen_id").join(j, "project_id").join(u, "run_id")
        .join(e, "experiment_id").withColumn("source", F.lpad(F.col("readset_id").cast("string"), 14, "0"))
    )


def _uri(host: str) -> Column:
    """One uri per (readset, file)."""
    return F.concat(F.lit(f"{host}:///run/"), "readset_id", F.lit("/"), "file_id")


def _files(t: Tables, item: Column) -> DataFrame:
    f = t["file"].select(F.col("id").alias("file_id"), "name", "md5sum", "deliverable", "extra_metadata")
    rows = t["readset_file"].join(f.hint("merge"), "file_id")
    return rows.groupBy("readset_id").agg(F.array_sort(F.collect_list(item)).alias("file"))


def run_processing_reports(t: Tables) -> str:
    item = F.struct(
        _uri("alpha").alias("location_uri"), F.col("name").alias("file_name"), F.col("md5sum").alias("file_md5sum"),
        F.col("deliverable").alias("file_deliverable"), F.col("extra_metadata").alias("file_extra_metadata"),
    )
    metric = F.struct(
        F.concat(F.lit("op"), "operation_id").alias("metric_name"),
        F.col("operation_id").cast("string").alias("metric_value"), F.lit("PASS").alias("metric_flag"),
        (F.col("operation_id") % 2 == 0).alias("metric_deliverable"),
    )
    metrics = t["readset_operation"].groupBy("readset_id").agg(F.array_sort(F.collect_list(metric)).alias("metric"))
    rows = _readsets(t).join(_files(t, item), "readset_id", "left").join(metrics, "readset_id", "left")
    readset = F.struct(
        F.lit("WGS").alias("experiment_type"), F.col("nucleic_acid_type").alias("experiment_nucleic_acid_type"),
        F.col("library_kit").alias("experiment_library_kit"), "readset_name", F.col("lane").alias("readset_lane"),
        F.col("adapter1").alias("readset_adapter1"), F.col("adapter2").alias("readset_adapter2"),
        F.col("sequencing_type").alias("readset_sequencing_type"), "file", "metric",
    )
    sample = F.struct(
        "sample_name", F.col("tumour").alias("sample_tumour"),
        F.array(F.concat(F.lit("alias"), F.col("readset_id") % 2)).alias("sample_alias"), F.array(readset).alias("readset"),
    )
    specimen = F.struct(
        "specimen_name", F.col("cohort").alias("specimen_cohort"), F.lit("I1").alias("specimen_institution"),
        F.array(sample).alias("sample"),
    )
    date = F.concat("run_id", F.lit(RUN_DATE))
    return write_reports(rows, [
        F.lit("alpha").alias("operation_platform"), "project_name", "run_name", F.lit("novaseq").alias("run_instrument"),
        date.alias("run_date"), date.alias("job_start"), date.alias("job_stop"), F.array(specimen).alias("specimen"),
    ])


def move_reports(t: Tables, source: str, dest: str, delivery: bool = False) -> str:
    item = F.struct(_uri(source).alias("src_location_uri"), _uri(dest).alias("dest_location_uri"))
    rows = _readsets(t).join(_files(t, item), "readset_id")
    date = F.concat("run_id", F.lit("-05-05 05:05:05"))
    fields = [
        "project_name", F.lit("alpha").alias("operation_platform"), F.lit("globus").alias("operation_cmd_line"),
        date.alias("job_start"), date.alias("job_stop"), F.array(F.struct("readset_name", "file")).alias("readset"),
    ]
    if delivery:
        fields.append((F.col("readset_id") % 2 == 0).alias("delete"))
    return write_reports(rows, fields)


def pipeline_reports(t: Tables, change: int = 50) -> str:
    """Per readset a job of its own, and one job all readsets share, whose summary file and
    metric change every ``change`` readsets; and a job without status."""
    era = F.floor(F.col("readset_id") / change).cast("string")
    none = F.lit(None).cast("string")
    own = F.struct(
        F.concat(F.lit("trim."), "readset_name").alias("job_name"), F.lit("2024-01-01 00:00:00").alias("job_start"),
        F.lit("2024-01-01 01:00:00").alias("job_stop"), F.lit("COMPLETED").alias("job_status"),
        F.array(F.struct(
            F.concat(F.lit("alpha:///trim/"), "readset_name").alias("location_uri"),
            F.concat("readset_name", F.lit(".trim.fastq.gz")).alias("file_name"), F.md5("readset_name").alias("file_md5sum"),
            F.lit(True).alias("file_deliverable"),
        )).alias("file"),
        F.array(F.struct(
            F.lit("reads").alias("metric_name"), F.col("readset_id").cast("string").alias("metric_value"),
            F.lit("PASS").alias("metric_flag"),
        )).alias("metric"),
    )
    shared = F.struct(
        F.lit("merge").alias("job_name"), none.alias("job_start"), none.alias("job_stop"), F.lit("COMPLETED").alias("job_status"),
        F.array(F.struct(
            F.lit("alpha:///merge/summary.txt").alias("location_uri"), F.lit("summary.txt").alias("file_name"),
            F.md5(era).alias("file_md5sum"), F.lit(False).alias("file_deliverable"),
        )).alias("file"),
        F.array(F.struct(
            F.lit("merged").alias("metric_name"), era.alias("metric_value"), F.lit("WARNING").alias("metric_flag"),
        )).alias("metric"),
    )
    silent = F.struct(
        F.lit("qc").alias("job_name"), none.alias("job_start"), none.alias("job_stop"), none.alias("job_status"),
        F.lit(None).cast("array<struct<location_uri:string,file_name:string,file_md5sum:string,file_deliverable:boolean>>").alias("file"),
        F.lit(None).cast("array<struct<metric_name:string,metric_value:string,metric_flag:string>>").alias("metric"),
    )
    rows = _readsets(t)
    sample = F.struct("sample_name", F.array(F.struct("readset_name", F.array(own, shared, silent).alias("job"))).alias("readset"))
    return write_reports(rows, [
        F.col("project_name"), F.lit("cfg").alias("operation_config_name"), F.lit("1").alias("operation_config_version"),
        F.lit("m1").alias("operation_config_md5sum"), F.lit("a = 1").alias("operation_config_data"),
        F.lit("alpha").alias("operation_platform"), F.lit("run").alias("operation_cmd_line"), F.array(sample).alias("sample"),
    ])


_memo: dict[tuple[int, str], object] = {}


def _once(t: Tables, name: str, make):
    """Results are files already; queries of one folder share them."""
    key = (id(t["project"]), name)
    if key not in _memo:
        _memo[key] = make()
    return _memo[key]


def _fixed(out: Loaded, base: Tables) -> Tables:
    """The tables after a load: new rows written beside the old ones, a table with changed rows anew."""
    inserts = {k: v if k in out.updates else cut(v, k) for k, v in out.inserts.items()}
    fixed = Loaded(inserts, out.updates).tables(base)
    return {k: cut(v, k) if k in out.updates else v for k, v in fixed.items()}


def empty_with_projects(t: Tables) -> Tables:
    spark = t["project"].sparkSession
    empty = empty_tables(spark)
    _, new = create_project(empty, t["project"].select(F.lower("name").alias("name")), AS_OF)
    return {**empty, "project": new}


def damaged(spark, path: str, level: str) -> str:
    """The reports of ``path`` with three of four made unreadable: cut off, with a number where the
    list ``level`` belongs, or no JSON at all; and a file without content."""
    lines = spark.read.text(path)
    number = F.regexp_extract("value", '"source":"0*([0-9]+)"', 1).cast("bigint")
    head = F.concat(F.lit('{"readset_id":'), number.cast("string"), F.lit(","))
    rest = F.substring("value", F.lit(2), F.length("value"))
    kind = number % 4
    broken = F.when(kind == 0, F.col("value")).when(kind == 1, F.concat(head, F.substring(rest, F.lit(1), F.floor(F.length(rest) / 2).cast("int")))).when(
        kind == 2, F.concat(head, F.lit(f'"{level}":7}}'))).otherwise(F.concat(F.lit("lost "), head))
    out = scratch_path(spark, "damaged")
    lines.select(broken.alias("value")).write.text(out, compression="gzip")
    lines.select("value").filter(F.lit(False)).coalesce(1).write.mode("append").text(out)
    return out


def loaded_runs(t: Tables) -> tuple[Loaded, Tables]:
    """Run-processing reports loaded into tables that hold projects only."""
    def make():
        base = empty_with_projects(t)
        docs = read_reports(t["project"].sparkSession, run_processing_reports(t), "run_processing")
        out = ingest_run_processing(base, docs, AS_OF)
        return out, _fixed(out, base)

    return _once(t, "runs", make)


def reloaded_runs(t: Tables) -> Loaded:
    """The same reports once more: every readset is there already."""
    def make():
        docs = read_reports(t["project"].sparkSession, run_processing_reports(t), "run_processing")
        return ingest_run_processing(loaded_runs(t)[1], docs, AS_OF)

    return _once(t, "runs again", make)


def loaded_transfers(t: Tables) -> tuple[Loaded, Tables]:
    def make():
        base = loaded_runs(t)[1]
        docs = read_reports(t["project"].sparkSession, move_reports(t, "alpha", "bravo"), "transfer")
        out = ingest_transfer(base, docs, AS_OF)
        return out, _fixed(out, base)

    return _once(t, "transfers", make)


def loaded_deliveries(t: Tables) -> tuple[Loaded, Tables]:
    def make():
        base = loaded_transfers(t)[1]
        docs = read_reports(t["project"].sparkSession, move_reports(t, "bravo", "handoff", True), "delivery")
        out = ingest_delivery(base, docs, AS_OF)
        return out, _fixed(out, base)

    return _once(t, "deliveries", make)


def loaded_pipelines(t: Tables) -> tuple[Loaded, Tables]:
    def make():
        base = loaded_runs(t)[1]
        docs = read_reports(t["project"].sparkSession, pipeline_reports(t), "pipeline_run")
        out = ingest_pipeline_run(base, docs, AS_OF)
        return out, _fixed(out, base)

    return _once(t, "pipelines", make)


def reloaded_pipelines(t: Tables) -> tuple[Loaded, Tables]:
    def make():
        base = loaded_pipelines(t)[1]
        docs = read_reports(t["project"].sparkSession, pipeline_reports(t), "pipeline_run")
        out = ingest_pipeline_run(base, docs, AS_OF)
        return out, _fixed(out, base)

    return _once(t, "pipelines again", make)
