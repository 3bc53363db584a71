"""The four hand-off reports: readset files, tumour/normal pairs, unanalyzed, delivery.

A request is a dict: ``experiment_nucleic_acid_type``, ``location_endpoint`` and any of
``specimen_name``/``specimen_id``/``sample_name``/``sample_id``/``readset_name``/
``readset_id`` as lists.  A value may also be a one-column DataFrame where the list is long.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import after_scheme, as_text, json_field
from ..schemas import NUCLEIC_ACID_TYPES, PIPELINE, RUN_PROCESSING
from ..session import cut
from .entities import Ids, Tables, _list
from .grouping import only_ids

SELECTORS = ("specimen", "sample", "readset")

# File types read as fastq, and the quality offset of the readset file.
FASTQ_TYPES = ("fastq", "fq", "fq.gz", "fastq.gz")
QUALITY_OFFSET = "33"


def nucleic_acid_type(request: dict) -> str:
    value = request.get("experiment_nucleic_acid_type")
    if value not in NUCLEIC_ACID_TYPES:
        raise ValueError(f"experiment_nucleic_acid_type must be one of {NUCLEIC_ACID_TYPES}")
    return value


def _wanted(rows: DataFrame, by: str, request: dict) -> DataFrame | None:
    """Rows named or numbered by the request (name OR id); None if it names none."""
    parts = []
    for col, key in (("name", f"{by}_name"), ("id", f"{by}_id")):
        value = request.get(key)
        if value is None:
            continue
        if isinstance(value, DataFrame):
            listed = value.select(F.col(value.columns[0]).alias(col)).distinct()
            parts.append(rows.join(listed, col, "left_semi").select(*rows.columns))
        else:
            parts.append(rows.filter(F.col(col).isin(list(value))))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0].union(parts[1]).dropDuplicates(["id"])


def _in_project(t: Tables, project_id: Ids) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Slim specimen, sample and readset rows of a project, with their parents' names."""
    specimen = t["specimen"].filter(F.col("project_id").isin(_list(project_id)))
    sample = t["sample"]
    readset = t["readset"]
    return specimen, sample, readset


def _candidates(t: Tables, by: str, request: dict, project_id: Ids) -> DataFrame | None:
    """One row per (specimen, sample, readset or none) reached by the request's ``by`` rows."""
    specimen, sample, readset = _in_project(t, project_id)
    chosen = _wanted({"specimen": specimen, "sample": sample, "readset": readset}[by], by, request)
    if chosen is None:
        return None
    specimen = chosen if by == "specimen" else specimen
    sample = chosen if by == "sample" else sample
    readset = chosen if by == "readset" else readset
    p = specimen.select(
        F.col("id").alias("specimen_id"), F.col("name").alias("specimen_name"),
        "cohort", "institution",
    )
    s = sample.select(
        F.col("id").alias("sample_id"), F.col("name").alias("sample_name"), "tumour",
        F.col("specimen_id"), F.col("deprecated").alias("sample_deprecated"),
        F.col("deleted").alias("sample_deleted"),
    )
    r = readset.select(
        F.col("id").alias("readset_id"), F.col("name").alias("readset_name"), "sample_id",
        "experiment_id", "run_id", "lane", "adapter1", "adapter2", "sequencing_type",
        F.col("deprecated").alias("readset_deprecated"),
        F.col("deleted").alias("readset_deleted"),
    )
    how = "inner" if by == "readset" else "left"
    return s.join(p, "specimen_id").join(r, "sample_id", how)


def _experiment(t: Tables) -> DataFrame:
    return t["experiment"].select(
        F.col("id").alias("experiment_id"), "nucleic_acid_type", "library_kit"
    )


def _warning(code: str, entity: str, entity_id: Column, detail: Column) -> list[Column]:
    return [
        F.lit(code).alias("code"),
        F.lit(entity).alias("entity"),
        entity_id.cast("bigint").alias("entity_id"),
        detail.cast("string").alias("detail"),
    ]


def select_samples(
    t: Tables, by: str, request: dict, project_id: Ids
) -> tuple[DataFrame, DataFrame] | None:
    """Samples whose first readset is of the wanted type, and the warnings for the others.

    Selecting by readset keeps one row per matched readset.  The first readset is the one of
    lowest id.
    """
    nat = nucleic_acid_type(request)
    rows = _candidates(t, by, request, project_id)
    if rows is None:
        return None
    base = ["sample_id", "sample_name", "tumour", "specimen_id", "specimen_name",
            "sample_deprecated", "sample_deleted"]
    if by == "readset":
        # The type tested is still that of the sample's first readset overall.
        matched = rows.select(*base)
        owners = only_ids(t["readset"], matched, "sample_id", "sample_id")
        first = owners.groupBy("sample_id").agg(F.min_by("experiment_id", "id").alias("experiment_id"))
        rows = matched.join(first, "sample_id")
    else:
        # Grouping combines before its shuffle, so a sample with very many readsets is cheap.
        rows = rows.groupBy(*base).agg(
            F.min_by("experiment_id", "readset_id").alias("experiment_id"),
            F.count("readset_id").alias("readsets"),
        )
    typed = rows.join(_experiment(t), "experiment_id", "left")
    ok = (
        (F.col("nucleic_acid_type") == nat) & ~F.col("sample_deprecated") & ~F.col("sample_deleted")
    )
    ok = F.coalesce(ok, F.lit(False))
    out = typed.filter(ok).select("sample_id", "sample_name", "tumour", "specimen_id", "specimen_name")
    empty = (F.col("readsets") == 0) if by != "readset" else F.lit(False)
    rejected = typed.filter(~ok & ~empty).select(
        *_warning("wrong_type", "sample", F.col("sample_id"), F.col("nucleic_acid_type"))
    )
    if by != "readset":
        rejected = rejected.unionByName(
            typed.filter(empty).select(
                *_warning("no_readsets", "sample", F.col("sample_id"), F.col("sample_name"))
            )
        )
    return out, rejected


def select_readsets(
    t: Tables, by: str, request: dict, project_id: Ids
) -> tuple[DataFrame, DataFrame] | None:
    """Unflagged readsets of the wanted type, and a warning for every other one reached."""
    nat = nucleic_acid_type(request)
    rows = _candidates(t, by, request, project_id)
    if rows is None:
        return None
    typed = rows.filter(F.col("readset_id").isNotNull()).join(_experiment(t), "experiment_id", "left")
    ok = F.coalesce(
        (F.col("nucleic_acid_type") == nat)
        & ~F.col("readset_deprecated")
        & ~F.col("readset_deleted"),
        F.lit(False),
    )
    rejected = typed.filter(~ok).select(
        *_warning("wrong_type", "readset", F.col("readset_id"), F.col("nucleic_acid_type"))
    )
    out = typed.filter(ok).drop(
        "readset_deprecated", "readset_deleted", "sample_deprecated", "sample_deleted"
    )
    return out, rejected


def union_selectors(t: Tables, kind: str, request: dict, project_id: Ids) -> tuple[DataFrame, DataFrame]:
    """Rows of the specimen, sample and readset selectors together, duplicates kept."""
    select = {"sample": select_samples, "readset": select_readsets}[kind]
    found = [x for x in (select(t, by, request, project_id) for by in SELECTORS) if x is not None]
    if not found:
        raise ValueError("the request names no specimen, sample or readset")
    return (
        reduce(DataFrame.unionByName, [x[0] for x in found]),
        reduce(DataFrame.unionByName, [x[1] for x in found]),
    )


def file_uri_at(t: Tables, endpoint: str, skip_deleted: bool = False) -> DataFrame:
    """(file_id, uri): the path of each file's first location at an endpoint."""
    at = t["location"].filter(F.col("endpoint") == endpoint)
    if skip_deleted:
        at = at.filter(~F.col("deleted"))
    return at.groupBy("file_id").agg(after_scheme(F.min_by("uri", "id")).alias("uri"))


def readset_source_files(t: Tables, readset_ids: DataFrame) -> DataFrame:
    """(readset_id, file_id) pairs in which the file came out of a job of one of the
    readset's run-processing operations and is linked to the readset as well."""
    ops = t["operation"].filter(F.col("name") == RUN_PROCESSING).select(F.col("id").alias("operation_id"))
    jobs = t["job"].select(F.col("id").alias("job_id"), "operation_id").join(ops, "operation_id", "left_semi")
    made_by = t["job_file"].join(jobs, "job_id").select("file_id", "operation_id").distinct()
    rf = t["readset_file"].join(readset_ids.select("readset_id").distinct(), "readset_id", "left_semi")
    # Start from the file links, never from operation x jobs, so that an operation shared by
    # very many readsets does not multiply with all of its files.
    return (
        rf.join(made_by, "file_id")
        .join(t["readset_operation"], ["readset_id", "operation_id"], "left_semi")
        .select("readset_id", "file_id")
        .distinct()
    )


def _slotted_files(t: Tables, request: dict, readset_ids: DataFrame) -> DataFrame:
    """Source files with the slot they fill (R1, R2, bam, bed) and their path, if any."""
    endpoint = request.get("location_endpoint")
    kind = F.col("type")
    read = json_field(F.col("extra_metadata"), "read_type")
    slot = (
        F.when(kind.isin(*FASTQ_TYPES) & read.isin("R1", "R2"), read)
        .when(kind == "bam", F.lit("bam"))
        .when(kind == "bed", F.lit("bed"))
    )
    wanted = (
        t["file"].withColumn("slot", slot).filter(F.col("slot").isNotNull())
        .select(F.col("id").alias("file_id"), F.col("name").alias("file_name"), "slot")
    )
    located = file_uri_at(t, endpoint)
    return (
        readset_source_files(t, readset_ids)
        .join(wanted, "file_id")
        .join(located, "file_id", "left")
        .withColumn(
            "path",
            F.when(F.col("slot") == "bed", F.col("file_name")).otherwise(
                F.nullif(F.col("uri"), F.lit(""))
            ),
        )
    )


def digest_readset_file(
    t: Tables, project_id: Ids, request: dict
) -> tuple[DataFrame, DataFrame]:
    """One row per selected readset with its fastq, bam and bed paths; and the warnings.

    Of several files for one slot the one of highest id counts.
    """
    selected, rejected = union_selectors(t, "readset", request, project_id)
    # Used several times below; written once.
    selected = cut(selected, "selected")
    slotted = cut(_slotted_files(t, request, selected), "slotted")

    def pick(slot: str, alias: str) -> Column:
        hit = (F.col("slot") == slot) & F.col("path").isNotNull()
        return F.max_by(F.when(hit, F.col("path")), F.when(hit, F.col("file_id"))).alias(alias)

    slots = slotted.groupBy("readset_id").agg(
        pick("bed", "BED"), pick("R1", "FASTQ1"), pick("R2", "FASTQ2"), pick("bam", "BAM")
    )
    run = t["run"].select(F.col("id").alias("run_id"), F.col("name").alias("run_name"))
    rows = (
        selected.join(run, "run_id", "left")
        .join(slots, "readset_id", "left")
        .select(
            F.col("sample_name").alias("Sample"),
            F.col("readset_name").alias("Readset"),
            F.col("library_kit").alias("LibraryType"),
            F.col("sequencing_type").alias("RunType"),
            F.col("run_name").alias("Run"),
            F.col("lane").alias("Lane"),
            F.col("adapter1").alias("Adapter1"),
            F.col("adapter2").alias("Adapter2"),
            F.lit(QUALITY_OFFSET).alias("QualityOffset"),
            "BED", "FASTQ1", "FASTQ2", "BAM",
        )
    )
    return rows, rejected.unionByName(missing_slot_files(t, request, slotted))


def missing_slot_files(t: Tables, request: dict, slotted: DataFrame) -> DataFrame:
    """Wanted files that are not at the endpoint: one warning per endpoint that has them,
    one without endpoint where none has."""
    missing = slotted.filter(F.col("path").isNull()).select("readset_id", "file_id")
    places = t["location"].select("file_id", "endpoint").distinct()
    return missing.join(places, "file_id", "left").select(
        F.lit("file_not_at_endpoint").alias("code"),
        F.lit("readset").alias("entity"),
        F.col("readset_id").alias("entity_id"),
        F.concat_ws("@", F.col("file_id").cast("string"), F.coalesce("endpoint", F.lit("-"))).alias("detail"),
    )


def readset_file_warnings(t: Tables, project_id: Ids, request: dict) -> DataFrame:
    selected = cut(union_selectors(t, "readset", request, project_id)[0], "selected")
    return missing_slot_files(t, request, _slotted_files(t, request, selected))


def digest_pair_file(t: Tables, project_id: Ids, request: dict) -> tuple[DataFrame, DataFrame]:
    """Per specimen one normal and one tumour sample; of several the one of highest id."""
    selected, rejected = union_selectors(t, "sample", request, project_id)

    def last(tumour: bool, alias: str) -> Column:
        hit = F.coalesce(F.col("tumour"), F.lit(False)) == tumour
        return F.max_by(F.when(hit, F.col("sample_name")), F.when(hit, F.col("sample_id"))).alias(alias)

    pairs = selected.groupBy(F.col("specimen_name").alias("Specimen")).agg(
        last(False, "Sample_N"), last(True, "Sample_T")
    )
    return pairs, rejected


UNANALYZED_KEYS = ("sample_name", "sample_id", "readset_name", "readset_id")


def digest_unanalyzed(
    t: Tables, project_id: Ids, key: str, nat: str, run_id: int | None = None,
    run_name: str | None = None, strict: bool = False, pipeline: str = PIPELINE,
) -> DataFrame:
    """Samples or readsets not analyzed yet: valid readsets joined to every operation that is
    not of the pipeline.

    One row per (readset, other operation), as the operation test is made row by row.
    ``strict`` returns each readset without any pipeline operation once instead.
    """
    if key not in UNANALYZED_KEYS:
        raise ValueError(f"key must be one of {UNANALYZED_KEYS}")
    nucleic_acid_type({"experiment_nucleic_acid_type": nat})
    specimen = only_ids(
        t["specimen"].filter(F.col("project_id").isin(_list(project_id))), t["project"], "project_id"
    )
    s = only_ids(t["sample"], specimen, "specimen_id").select(
        F.col("id").alias("sample_id"), F.col("name").alias("sample_name")
    )
    readset = t["readset"].filter(
        (F.col("state") == "VALID") & ~F.col("deprecated") & ~F.col("deleted")
    )
    if run_name is not None and run_id is None:
        named = t["run"].filter(F.col("name") == run_name).agg(F.min("id").alias("id"))
        readset = only_ids(readset, named, "run_id")
    elif run_id is not None:
        readset = only_ids(readset.filter(F.col("run_id") == run_id), t["run"], "run_id")
    kind = t["experiment"].filter(F.col("nucleic_acid_type") == nat)
    r = only_ids(readset, kind, "experiment_id").select(
        F.col("id").alias("readset_id"), F.col("name").alias("readset_name"), "sample_id"
    )
    ops = t["operation"].select(F.col("id").alias("operation_id"), F.col("name").alias("operation_name"))
    pattern = f"%{pipeline}%"
    linked = r.join(s, "sample_id")
    if strict:
        done = only_ids(
            t["readset_operation"], ops.filter(F.col("operation_name").ilike(pattern)),
            "operation_id", "operation_id",
        )
        return linked.join(done.select("readset_id").distinct(), "readset_id", "left_anti").select(key)
    # A null name matches neither pattern nor its negation.
    other = ops.filter(~F.col("operation_name").ilike(pattern)).select("operation_id")
    pairs = t["readset_operation"].join(other, "operation_id", "left_semi")
    return linked.join(pairs, "readset_id").select(key)


def delivery_operations(t: Tables, readset_ids: DataFrame) -> DataFrame:
    """The first operation per config among the readsets, kept if it has a command line and
    config data.  A config whose first operation lacks them yields nothing."""
    links = t["readset_operation"].join(
        readset_ids.select("readset_id").distinct(), "readset_id", "left_semi"
    )
    ops = t["operation"].filter(F.col("operation_config_id").isNotNull()).select(
        F.col("id").alias("operation_id"), "operation_config_id", "cmd_line"
    )
    configs = t["operation_config"].select(F.col("id").alias("operation_config_id"), "data")
    # First seen = lowest readset, then lowest operation; a minimum combines before shuffling.
    firsts = links.groupBy("operation_id").agg(F.min("readset_id").alias("readset_id"))
    picked = firsts.join(ops, "operation_id").groupBy("operation_config_id").agg(
        F.min_by(F.struct("operation_id", "cmd_line"), F.struct("readset_id", "operation_id")).alias("op")
    )
    return (
        picked.join(configs, "operation_config_id")
        .filter((F.col("op.cmd_line") != "") & (F.length("data") > 0))
        .select(
            "operation_config_id",
            F.col("op.operation_id").alias("operation_id"),
            F.col("op.cmd_line").alias("cmd_line"),
            as_text(F.col("data")).alias("config_data"),
        )
    )


def _deliverable_links(t: Tables, readset_ids: DataFrame, endpoint: str | None) -> DataFrame:
    """Deliverable files of the readsets with their path at the endpoint, null where absent."""
    files = t["file"].filter(F.col("deliverable") & ~F.col("deleted")).select(
        F.col("id").alias("file_id"), F.col("name").alias("file_name")
    )
    rf = t["readset_file"].join(readset_ids.select("readset_id").distinct(), "readset_id", "left_semi")
    located = file_uri_at(t, endpoint, skip_deleted=True)
    return rf.join(files, "file_id").join(located, "file_id", "left").withColumn(
        "uri", F.nullif(F.col("uri"), F.lit(""))
    )


def delivery_files(t: Tables, readset_ids: DataFrame, endpoint: str) -> DataFrame:
    """(readset_id, file_id, name, location) of deliverable files present at the endpoint."""
    return _deliverable_links(t, readset_ids, endpoint).filter(F.col("uri").isNotNull()).select(
        "readset_id", "file_id", F.col("file_name").alias("name"), F.col("uri").alias("location")
    )


def delivery_metrics(t: Tables, readset_ids: DataFrame) -> DataFrame:
    """(readset_id, metric_id, name, value, aggregate, flag) of deliverable metrics."""
    metrics = t["metric"].filter("deliverable").select(
        F.col("id").alias("metric_id"), "name", "value", "aggregate", "flag"
    )
    rm = t["readset_metric"].join(readset_ids.select("readset_id").distinct(), "readset_id", "left_semi")
    return rm.join(metrics, "metric_id").select(
        "readset_id", "metric_id", "name", "value", "aggregate", "flag"
    )


def delivery_warnings(t: Tables, readset_ids: DataFrame, endpoint: str) -> DataFrame:
    """Deliverable files missing at the endpoint (one row per endpoint that has them), and
    readsets left without any deliverable file."""
    links = _deliverable_links(t, readset_ids, endpoint)
    places = t["location"].select("file_id", "endpoint").distinct()
    missing = links.filter(F.col("uri").isNull()).join(places, "file_id", "left").select(
        F.lit("file_not_at_endpoint").alias("code"),
        F.lit("readset").alias("entity"),
        F.col("readset_id").alias("entity_id"),
        F.concat_ws("@", F.col("file_id").cast("string"), F.coalesce("endpoint", F.lit("-"))).alias("detail"),
    )
    served = links.filter(F.col("uri").isNotNull()).select("readset_id").distinct()
    bare = readset_ids.select("readset_id").distinct().join(served, "readset_id", "left_anti").select(
        *_warning("no_deliverable_files", "readset", F.col("readset_id"), F.lit(endpoint))
    )
    return missing.unionByName(bare)


def nest_delivery(readsets: DataFrame) -> DataFrame:
    """One nested row per specimen: sample[] of readset[] of file[] and metric[].

    The shape of the report for a selection that is handed on as one document; bulk work keeps
    the readset rows.
    """
    top = ["location_endpoint", "experiment_nucleic_acid_type", "specimen_name", "cohort", "institution"]
    readset = F.struct("id", "copy", "name", "file", "metric")
    per_sample = readsets.groupBy(*top, "sample_name", "tumour").agg(
        F.array_sort(F.collect_list(readset)).alias("readset")
    )
    sample = F.struct(F.col("sample_name").alias("name"), "tumour", "readset")
    nested = per_sample.groupBy(*top).agg(F.array_sort(F.collect_list(sample)).alias("sample"))
    return nested.withColumnRenamed("specimen_name", "name")


def digest_delivery(t: Tables, project_id: Ids, request: dict) -> dict[str, DataFrame]:
    """The delivery report.

    ``operation``: command line and config text per config.  ``readset``: one row per selected
    readset with file[] and metric[] and the names above it, at any size of the selection.
    ``specimen``: the same nested per specimen.  ``warnings``.
    """
    endpoint = request.get("location_endpoint")
    selected, rejected = union_selectors(t, "readset", request, project_id)
    selected = cut(selected, "selected")
    readsets = selected.dropDuplicates(["readset_id"])
    # Selected twice means listed twice, as the three selectors are simply concatenated.
    copies = selected.groupBy("readset_id").agg(F.count(F.lit(1)).alias("copies"))
    head = readsets.join(copies, "readset_id").select(
        "readset_id", "readset_name", "sample_name", "tumour", "specimen_name", "cohort",
        "institution", "copies",
    )
    head = head.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    file_t = "struct<id:bigint,name:string,location:string>"
    metric_t = "struct<id:bigint,name:string,value:string,aggregate:string,flag:string>"
    files = delivery_files(t, readsets, endpoint).select(
        "readset_id", F.col("file_id").alias("item"),
        F.struct(F.col("file_id").alias("id"), "name", "location").cast(file_t).alias("f"),
        F.lit(None).cast(metric_t).alias("m"),
    )
    metrics = delivery_metrics(t, readsets).select(
        "readset_id", F.col("metric_id").alias("item"),
        F.lit(None).cast(file_t).alias("f"),
        F.struct(F.col("metric_id").alias("id"), "name", "value", "aggregate", "flag")
        .cast(metric_t).alias("m"),
    )
    entries = head.join(files.unionByName(metrics), "readset_id", "left")
    top = ["specimen_name", "cohort", "institution", "sample_name", "tumour"]
    rows = entries.groupBy(*top, "readset_id", "readset_name", "copy").agg(
        F.array_sort(F.collect_list("f")).alias("file"),
        F.array_sort(F.collect_list("m")).alias("metric"),
    ).select(
        F.lit(endpoint).alias("location_endpoint"),
        F.lit(nucleic_acid_type(request)).alias("experiment_nucleic_acid_type"),
        *top, F.col("readset_id").alias("id"), "copy", F.col("readset_name").alias("name"), "file", "metric",
    )
    return {
        "operation": delivery_operations(t, readsets),
        "readset": rows,
        "specimen": nest_delivery(rows),
        "warnings": rejected.unionByName(delivery_warnings(t, readsets, endpoint)),
    }
