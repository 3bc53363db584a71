from conftest import rows_of
from pyspark.sql import functions as F

from seqledger.operators import digests as d
from seqledger.operators import related as p
from seqledger.operators.rollup import rollup_metrics
from seqledger.schemas import PIPELINE

REQUEST = {"experiment_nucleic_acid_type": "DNA", "location_endpoint": "here", "specimen_name": ["P1"]}


def world(make, files=3):
    return make(
        project=[{"id": 1, "name": "J"}], specimen=[{"id": 1, "project_id": 1, "name": "P1", "cohort": "C"}],
        sample=[
            {"id": 1, "specimen_id": 1, "name": "N1", "tumour": False}, {"id": 2, "specimen_id": 1, "name": "N2", "tumour": False},
            {"id": 3, "specimen_id": 1, "name": "T1", "tumour": True}, {"id": 4, "specimen_id": 1, "name": "bare"},
            {"id": 5, "specimen_id": 1, "name": "rna", "tumour": True},
        ],
        experiment=[{"id": 1, "nucleic_acid_type": "DNA"}, {"id": 2, "nucleic_acid_type": "RNA"}],
        readset=[
            {"id": i, "name": f"R{i}", "sample_id": s, "experiment_id": e, "state": "VALID"}
            for i, s, e in ((1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 3, 2), (5, 5, 2), (6, 5, 1))
        ],
        operation_config=[{"id": 1, "data": bytearray(b"text")}, {"id": 2, "data": bytearray(b"more")}],
        operation=[
            {"id": 1, "name": "run_processing", "operation_config_id": 1}, {"id": 2, "name": "x", "operation_config_id": 1, "cmd_line": "late"},
            {"id": 3, "name": PIPELINE, "operation_config_id": 2, "cmd_line": "go"},
        ],
        job=[{"id": 1, "operation_id": 1}],
        file=[{"id": i, "name": f"f{i}.bam", "type": "bam", "deliverable": True} for i in range(1, files + 1)],
        location=[
            {"id": 1, "file_id": 1, "uri": "here:///a", "endpoint": "here", "deleted": True}, {"id": 2, "file_id": 1, "uri": "here:///b", "endpoint": "here"},
            {"id": 3, "file_id": 2, "uri": "there:///c", "endpoint": "there"},
        ] + [{"id": 10 + i, "file_id": i, "uri": f"here:///f{i}", "endpoint": "here"} for i in range(3, files + 1)],
        readset_file=[{"readset_id": 1, "file_id": i} for i in range(1, files + 1)],
        job_file=[{"job_id": 1, "file_id": 1}, {"job_id": 1, "file_id": 2}],
        readset_operation=[{"readset_id": 1, "operation_id": i} for i in (1, 2, 3)] + [{"readset_id": 3, "operation_id": 1}],
        metric=[{"id": 1, "job_id": 1, "name": "m", "value": "1", "deliverable": True}],
        readset_metric=[{"readset_id": 1, "metric_id": 1}],
    )


def test_pair_takes_the_last_sample_and_the_first_readset_decides_the_type(make):
    pairs, warnings = d.digest_pair_file(world(make), 1, REQUEST)
    assert rows_of(pairs, "Specimen", "Sample_N", "Sample_T") == [("P1", "N2", "T1")]
    assert rows_of(warnings, "code", "entity_id") == [("no_readsets", 4), ("wrong_type", 5)]


def test_readset_file_ignores_flags_and_reports_missing_files(make):
    rows, warnings = d.digest_readset_file(world(make), 1, {**REQUEST, "readset_id": [1]})
    # Selected twice, listed twice; the first location counts even if deleted.
    assert rows_of(rows.filter("Readset = 'R1'"), "BAM", "QualityOffset", "Lane") == [("/a", "33", None)] * 2
    assert rows_of(warnings.filter("code = 'file_not_at_endpoint'"), "entity_id", "detail") == [(1, "2@there")]


def test_unanalyzed_is_decided_row_by_row_unless_strict(make):
    t = world(make)
    assert rows_of(d.digest_unanalyzed(t, 1, "readset_id", "DNA"), "readset_id") == [(1,), (1,), (3,)]
    assert rows_of(d.digest_unanalyzed(t, 1, "readset_id", "DNA", strict=True), "readset_id") == [(2,), (3,), (6,)]


def test_delivery(make):
    out = d.digest_delivery(world(make), 1, REQUEST)
    # Config 1 is spent on its first operation, which has no command line.
    assert rows_of(out["operation"], "cmd_line", "config_data") == [("go", "more")]
    row = out["specimen"].first()
    r1 = next(r for s in row["sample"] for r in s["readset"] if r["name"] == "R1")
    assert [(f["name"], f["location"]) for f in r1["file"]] == [("f1.bam", "/b"), ("f3.bam", "/f3")]
    assert [(m["name"], m["flag"]) for m in r1["metric"]] == [("m", None)]
    codes = rows_of(out["warnings"].groupBy("code").count(), "code", "count")
    assert codes == [("file_not_at_endpoint", 1), ("no_deliverable_files", 3), ("wrong_type", 2)]


def test_delivery_has_one_row_per_readset_and_nests_into_one_per_specimen(make):
    out = d.digest_delivery(world(make, files=40), 1, REQUEST)
    flat = out["readset"].select("specimen_name", "sample_name", F.col("name").alias("r"), F.explode("file.name").alias("f"))
    rows = out["specimen"].select(F.col("name").alias("specimen_name"), F.explode("sample").alias("s"))
    rows = rows.select("specimen_name", F.col("s.name").alias("sample_name"), F.explode("s.readset").alias("r"))
    rows = rows.select("specimen_name", "sample_name", F.col("r.name").alias("r"), F.explode("r.file.name").alias("f"))
    cols = ("specimen_name", "sample_name", "r", "f")
    assert out["specimen"].count() == 1 and rows_of(rows, *cols) == rows_of(flat, *cols) and flat.count() == 39


def test_related_ids_keep_nulls_for_hidden_readsets(make):
    t = make(
        sample=[{"id": 1}, {"id": 2}],
        readset=[{"id": 1, "sample_id": 1}, {"id": 2, "sample_id": 1, "deleted": True}, {"id": 3, "sample_id": 1, "deleted": True, "deprecated": True}],
    )
    assert rows_of(p.with_related(t, "sample"), "id", "readset_ids") == [(1, [1, 2, None]), (2, [])]
    assert rows_of(p.related_ids(t, "sample"), "id", "kind", "related_id") == [
        (1, "readset", 1), (1, "readset", 2), (1, "readset", None),
    ]
    few = t["sample"].filter("id = 2")
    assert rows_of(p.related_ids(t, "sample", rows=few), "id") == [] and p.with_related(t, "sample", few).count() == 1


def test_rollup_counts_a_shared_metric_once_per_sample(make):
    t = make(
        sample=[{"id": 1}], readset=[{"id": 1, "sample_id": 1}, {"id": 2, "sample_id": 1}],
        metric=[
            {"id": 1, "name": "a", "value": "2", "aggregate": "SUM"}, {"id": 2, "name": "a", "value": "x", "aggregate": "SUM"},
            {"id": 3, "name": "b", "value": "3", "aggregate": "AVERAGE"}, {"id": 4, "name": "c", "value": "t"},
        ],
        readset_metric=[{"readset_id": r, "metric_id": m} for r in (1, 2) for m in (1, 2, 3, 4)],
    )
    assert rows_of(rollup_metrics(t), "name", "number", "value", "metrics") == [
        ("a", 2.0, None, 2), ("b", 3.0, None, 1), ("c", None, "t", 1),
    ]
