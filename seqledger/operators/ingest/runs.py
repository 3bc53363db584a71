"""Run-processing reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions import compact_json, date_or, file_type
from ...schemas import FLAGS, LANES, LONG_DATE, NUCLEIC_ACID_TYPES, RUN_PROCESSING, SEQUENCING_TYPES, SHORT_DATE
from ...session import cut, side
from ..entities import Tables
from ..grouping import allocate_ranges
from ..validate import date_errors, enum_violations, error_rows, existing_names, repeated_names
from .base import (
    Loaded,
    Moment,
    beside,
    complete,
    link,
    moment,
    numbered,
    once,
    place,
    readable,
    settle_links,
    upsert_experiment,
    upsert_job,
    upsert_location,
    upsert_operation,
    upsert_readset,
    upsert_run,
    upsert_sample,
    upsert_specimen,
)


def _levels(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    specimens = docs.select("doc", "project_id", F.posexplode("specimen").alias("a", "s")).select(
        "doc", "project_id", "a", place("doc", "a").alias("pos"), F.col("s.specimen_name").alias("name"),
        F.col("s.specimen_cohort").alias("cohort"), F.col("s.specimen_institution").alias("institution"),
        F.col("s.sample").alias("sample"),
    )
    samples = specimens.select("doc", "a", F.posexplode("sample").alias("b", "s")).select(
        "doc", "a", "b", place("doc", "a", "b").alias("pos"), F.col("s.sample_name").alias("name"),
        F.col("s.sample_alias").alias("alias"), F.col("s.sample_tumour").alias("tumour"),
        F.col("s.readset").alias("readset"),
    )
    readsets = samples.select("doc", "a", "b", F.posexplode("readset").alias("c", "r")).select(
        "doc", "a", "b", "c", place("doc", "a", "b", "c").alias("pos"), "r.*",
        F.col("r.readset_name").alias("name"),
    )
    return specimens.drop("sample"), samples.drop("readset"), readsets


def _not_in(rows: DataFrame, domains: dict[str, tuple[str, ...]]) -> DataFrame:
    """(doc, text) of values outside their domain, or absent where one is required."""
    bad = F.filter(
        F.array(*[F.when(F.col(c).isNull() | ~F.col(c).isin(list(d)), F.concat_ws("=", F.lit(c), F.col(c))) for c, d in domains.items()]),
        lambda x: x.isNotNull(),
    )
    return rows.select("doc", F.explode(bad).alias("text"))


def _narrow(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents and their levels without the lists of files and metrics, of which the lengths are
    kept.  Each is written once and read by many checks and joins."""
    specimens, samples, readsets = _levels(docs)

    def length(c: str) -> Column:
        return F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0)).alias(c)

    kept = [c for c in readsets.columns if c not in ("file", "metric")]
    return (
        cut(docs.drop("specimen"), "heads"), cut(specimens, "specimens"), cut(samples, "samples"),
        cut(readsets.select(*kept, length("file"), length("metric")), "readset-rows"),
    )


def run_processing_errors(t: Tables, nested: DataFrame, docs: DataFrame, specimens: DataFrame, samples: DataFrame, readsets: DataFrame) -> DataFrame:
    metrics = _levels(nested)[2].select("doc", F.explode("metric").alias("m")).select("doc", "m.metric_flag", "m.metric_name")
    flagged = {
        name: side(cut(t[name].filter(F.col("deprecated") | F.col("deleted")).select("name").distinct(), "flagged"))
        for name in ("specimen", "sample")
    }
    parts = [
        error_rows(docs.filter(F.col("project_id").isNull()), "project_missing", "project", F.col("project_name")),
        error_rows(
            docs.filter(F.try_to_timestamp("run_date", F.lit(LONG_DATE)).isNull()), "bad_date", "run", F.col("run_date")
        ),
        date_errors(docs, ("job_start", "job_stop"), LONG_DATE, "job"),
        date_errors(readsets, ("experiment_kit_expiration_date",), SHORT_DATE, "experiment"),
        error_rows(existing_names(t, readsets.select("doc", "name")), "name_taken", "readset", F.col("name")),
        error_rows(repeated_names(readsets.select("doc", "name")), "name_repeated", "readset", F.col("name")),
        error_rows(enum_violations(metrics, "metric_flag", FLAGS), "bad_flag", "metric", F.col("metric_name")),
        error_rows(specimens.join(flagged["specimen"], "name", "left_semi"), "name_taken", "specimen", F.col("name")),
        error_rows(samples.join(flagged["sample"], "name", "left_semi"), "name_taken", "sample", F.col("name")),
    ]
    domains = {"experiment_nucleic_acid_type": NUCLEIC_ACID_TYPES, "readset_lane": LANES, "readset_sequencing_type": SEQUENCING_TYPES}
    parts.append(error_rows(_not_in(readsets, domains), "bad_value", "readset", F.col("text")))
    return reduce(DataFrame.unionByName, parts).distinct()


def ingest_run_processing(
    t: Tables, envelopes: DataFrame, as_of: Moment, project: str | None = None
) -> Loaded:
    """Insert operation, job, run, specimens, samples, experiments, readsets, files, locations,
    metrics and links of a batch of reports.  All readsets must be new; metrics are always
    inserted.  A document with an error is left out whole."""
    every = numbered(t, envelopes, project)
    docs, refused = readable(every)
    levels = _narrow(docs)
    errors = cut(run_processing_errors(t, docs, *levels).unionByName(refused), "errors")
    out = Loaded(errors=errors, docs=every.select("doc", "source"))
    without = beside(errors)
    good, specimens, samples, readsets = (without(x, "good") for x in levels)
    stamp = moment(as_of)

    head = good.select(
        "doc", "project_id", place().alias("pos"), F.col("operation_platform").alias("platform"),
        F.lit(RUN_PROCESSING).alias("name"), F.lit(None).cast("string").alias("cmd_line"),
        F.lit("COMPLETED").alias("status"), F.lit(None).cast("bigint").alias("operation_config_id"),
        F.lit(None).cast("bigint").alias("reference_id"), F.lit(None).cast("string").alias("type"),
        date_or(F.col("job_start"), LONG_DATE, stamp).alias("start"),
        date_or(F.col("job_stop"), LONG_DATE, stamp).alias("stop"),
    )
    head = upsert_job(t, out, upsert_operation(t, out, head, stamp), stamp)
    runs = upsert_run(t, out, good.select(
        "doc", place().alias("pos"), F.col("run_ext_id").alias("ext_id"), F.col("run_ext_src").alias("ext_src"),
        F.col("run_name").alias("name"), F.col("run_instrument").alias("instrument"),
        F.try_to_timestamp("run_date", F.lit(LONG_DATE)).alias("date"),
    ), stamp)
    doc_ids = side(cut(
        head.select("doc", "operation_id", "job_id").join(runs.select("doc", "run_id").hint("merge"), "doc"), "doc-ids"
    ))

    specimens = upsert_specimen(t, out, specimens, stamp).select("doc", "a", "specimen_id")
    samples = cut(samples.join(specimens.hint("merge"), ["doc", "a"]), "sample-rows")
    samples = upsert_sample(t, out, samples, stamp).select("doc", "a", "b", "sample_id")
    # Ids are found without the lists of files and metrics, which are moved once.
    rows = readsets.withColumns({
        "sequencing_technology": F.col("experiment_sequencing_technology"),
        "type": F.col("experiment_type"),
        "nucleic_acid_type": F.col("experiment_nucleic_acid_type"),
        "library_kit": F.col("experiment_library_kit"),
        "kit_expiration_date": F.try_to_timestamp("experiment_kit_expiration_date", F.lit(SHORT_DATE)),
        "lane": F.col("readset_lane"), "adapter1": F.col("readset_adapter1"),
        "adapter2": F.col("readset_adapter2"), "sequencing_type": F.col("readset_sequencing_type"),
    })
    at = ["doc", "a", "b", "c"]
    extra = ("sample_id", "experiment_id", "run_id", "lane", "adapter1", "adapter2", "sequencing_type")
    rows = upsert_experiment(t, out, rows, stamp).join(samples.hint("merge"), ["doc", "a", "b"]).join(doc_ids, "doc")
    rows = cut(rows.select(*at, "pos", "name", *extra, "operation_id", "job_id", "file", "metric"), "readset-parents")
    rows = upsert_readset(t, out, rows, stamp, extra)
    # New files and metrics take their ids from the lengths of the lists, so they need not move.
    rows = allocate_ranges(rows.select(*at, "pos", "readset_id", "operation_id", "job_id", "file", "metric"), {"file": t["file"], "metric": t["metric"]})
    ids = cut(rows.drop("pos"), "readset-ids")
    link(t, out, "readset_operation", ids)
    link(t, out, "readset_job", ids)
    # Documents with errors have no ids, so they drop out here.
    lists = _levels(once(docs))[2].select(*at, "file", "metric")
    rows = cut(lists.join(side(ids.drop("operation_id")), at), "readsets")

    files = rows.select("doc", "a", "b", "c", "readset_id", "job_id", "file_start", F.posexplode("file").alias("d", "f")).select(
        place("doc", "a", "b", "c", "d").alias("pos"), (F.col("file_start") + F.col("d") + 1).alias("file_id"), "readset_id", "job_id",
        F.col("f.location_uri").alias("uri"), F.col("f.file_name").alias("name"),
        F.col("f.file_md5sum").alias("md5sum"), F.col("f.file_deliverable").alias("deliverable"),
        compact_json(F.col("f.file_extra_metadata")).alias("extra_metadata"), file_type(F.col("f.file_name")).alias("type"),
    )
    out.inserts["file"] = complete(files.withColumn("id", F.col("file_id")), "file", stamp)
    link(t, out, "readset_file", files)
    link(t, out, "job_file", files)
    upsert_location(t, out, files.select("uri", "file_id", "pos"), stamp, move=True)

    metrics = rows.select("readset_id", "job_id", "metric_start", F.posexplode("metric").alias("d", "m")).select(
        (F.col("metric_start") + F.col("d") + 1).alias("metric_id"), "readset_id", "job_id",
        F.col("m.metric_name").alias("name"), F.col("m.metric_value").alias("value"),
        F.col("m.metric_flag").alias("flag"), F.col("m.metric_deliverable").alias("deliverable"),
    )
    out.inserts["metric"] = complete(metrics.withColumn("id", F.col("metric_id")), "metric", stamp)
    link(t, out, "readset_metric", metrics)
    settle_links(t, out)
    return out
