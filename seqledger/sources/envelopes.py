"""Readers of the four kinds of JSON report and of modification requests.

One document per file (or an array of documents); the schemas are explicit.  Free-form
objects are read as their JSON text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

_FILE = (
    "location_uri string, file_name string, file_md5sum string, file_deliverable boolean, "
    "file_extra_metadata string"
)
_METRIC = "metric_name string, metric_value string, metric_flag string, metric_deliverable boolean"

_RUN_READSET = (
    "experiment_sequencing_technology string, experiment_type string, "
    "experiment_nucleic_acid_type string, experiment_library_kit string, "
    "experiment_kit_expiration_date string, readset_name string, readset_lane string, "
    "readset_adapter1 string, readset_adapter2 string, readset_sequencing_type string, "
    "readset_quality_offset string, "
    f"file array<struct<{_FILE}>>, metric array<struct<{_METRIC}>>"
)
_RUN_SAMPLE = (
    "sample_ext_id bigint, sample_ext_src string, sample_name string, "
    f"sample_alias array<string>, sample_tumour boolean, readset array<struct<{_RUN_READSET}>>"
)
_RUN_SPECIMEN = (
    "specimen_ext_id bigint, specimen_ext_src string, specimen_name string, "
    f"specimen_cohort string, specimen_institution string, sample array<struct<{_RUN_SAMPLE}>>"
)
RUN_PROCESSING_SCHEMA = (
    "operation_platform string, project_ext_id bigint, project_ext_src string, "
    "project_name string, run_ext_id bigint, run_ext_src string, run_name string, "
    "run_instrument string, run_date string, job_start string, job_stop string, "
    f"specimen array<struct<{_RUN_SPECIMEN}>>"
)

_MOVE = "src_location_uri string, dest_location_uri string"
TRANSFER_SCHEMA = (
    "project_name string, operation_platform string, operation_cmd_line string, "
    "job_start string, job_stop string, job_end string, "
    f"readset array<struct<readset_name string, file array<struct<{_MOVE}>>>>"
)
DELIVERY_SCHEMA = f"{TRANSFER_SCHEMA}, delete boolean"

_PIPE_JOB = (
    "job_name string, job_start string, job_stop string, job_status string, "
    f"file array<struct<{_FILE}>>, metric array<struct<{_METRIC}>>"
)
PIPELINE_RUN_SCHEMA = (
    "project_name string, operation_config_name string, operation_config_version string, "
    "operation_config_md5sum string, operation_config_data string, operation_platform string, "
    "operation_cmd_line string, operation_name string, "
    "sample array<struct<sample_name string, readset array<struct<readset_name string, "
    f"job array<struct<{_PIPE_JOB}>>>>>>"
)

MODIFICATION_SCHEMA = (
    "modification array<struct<table string, id array<bigint>, column string, new string>>, "
    "dry_run boolean, cascade boolean, cascade_up boolean, cascade_down boolean"
)

ENVELOPE_SCHEMAS = {
    "run_processing": RUN_PROCESSING_SCHEMA,
    "transfer": TRANSFER_SCHEMA,
    "pipeline_run": PIPELINE_RUN_SCHEMA,
    "delivery": DELIVERY_SCHEMA,
}


def envelope_reader(reader, kind: str, multi_line: bool = True):
    """A batch or stream reader set up for one kind. What it can't parse comes as a document of
    its own whose ``unreadable`` holds the text; values of a wrong type count as such."""
    schema = f"{ENVELOPE_SCHEMAS[kind]}, unreadable string"
    return reader.schema(schema).option("multiLine", multi_line).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "unreadable")


def read_envelopes(spark: SparkSession, path: str, kind: str, multi_line: bool = True) -> DataFrame:
    """Documents of one kind with ``source``, a text that orders them within a batch.

    ``unreadable`` is null for a document that was read; else it holds the text that is cut off,
    no JSON object, or of other types than the kind has, and is empty for a file without content.
    The loaders refuse such documents. An array without documents is none, and what follows the
    first value of a file is not looked at.

    ``multi_line=False`` reads one document per line, which large drops should use: such
    files split across tasks, and a broken line does not take the others of its file with it.
    """
    docs = envelope_reader(spark.read, kind, multi_line).json(path).withColumn("source", F.col("_metadata.file_path"))
    return docs.unionByName(_without_content(spark, path, docs))


def _without_content(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    """A document for each file that has no line but blank ones, which the parser passes over."""
    lines = spark.read.text(path)
    # A scan leaves out files of no length, so the names come from the listing the driver has made.
    # It writes local paths with three slashes, the scan with one.
    files = spark.createDataFrame([(f,) for f in lines.inputFiles()], "source string").withColumn("source", F.regexp_replace("source", "^file:/+", "file:/"))
    filled = lines.filter(F.col("value").rlike(r"\S")).select(F.col("_metadata.file_path").alias("source")).distinct()
    empty = files.join(filled, "source", "left_anti")
    given = {"source": F.col("source"), "unreadable": F.lit("")}
    return empty.select(*[given.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in docs.schema.fields])


def quarantine(docs: DataFrame) -> DataFrame:
    """(source, digest, n_chars, text) of the documents that could not be read, to be kept apart.

    Source and digest name a document, so the rows of several readings can be merged.
    """
    # Written first, as the parser tells what it can't read only when it reads all columns.
    broken = cut(docs, "read").filter(F.col("unreadable").isNotNull())
    return broken.select(
        "source", F.md5("unreadable").alias("digest"), F.char_length("unreadable").cast("bigint").alias("n_chars"),
        F.col("unreadable").alias("text"))


def read_run_processing(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return read_envelopes(spark, path, "run_processing", multi_line)


def read_transfer(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return read_envelopes(spark, path, "transfer", multi_line)


def read_pipeline_run(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return read_envelopes(spark, path, "pipeline_run", multi_line)


def read_delivery(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return read_envelopes(spark, path, "delivery", multi_line)


def read_modifications(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Requests as one row per (entry, id), with the request's switches.

    Entries without ids give one row whose ``id`` is null, the "no ids" warning.
    """
    docs = spark.read.schema(MODIFICATION_SCHEMA).option("multiLine", multi_line).json(path)
    entries = docs.select(
        F.col("_metadata.file_path").alias("source"),
        *[F.coalesce(c, F.lit(False)).alias(c) for c in ("dry_run", "cascade", "cascade_up", "cascade_down")],
        F.posexplode("modification").alias("seq", "m"),
    )
    return entries.select(
        "source", "dry_run", "cascade", "cascade_up", "cascade_down",
        F.col("seq").cast("bigint").alias("seq"),
        F.col("m.table").alias("table"), F.col("m.column").alias("column"), F.col("m.new").alias("new"),
        F.explode_outer(F.array_distinct("m.id")).alias("id"),
    )
