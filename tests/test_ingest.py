"""Loading reports, against one-by-one simulations and hand-made documents."""

import json
import random

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from seqledger.operators import grouping as g
from seqledger.operators import ingest
from seqledger.operators.ingest.base import moment
from seqledger.operators.ingest.versions import version_metrics
from seqledger.sources import quarantine, read_delivery, read_pipeline_run, read_run_processing, read_transfer
from seqledger.sources.envelopes import read_envelopes
from seqledger.sources.tables import load_tables, write_tables
from seqledger.streaming import stream_ingest

AS_OF = "2024-05-05 00:00:00"


def put(folder, name, doc):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text(json.dumps(doc, indent=1))
    return str(folder)


def run_doc(readsets, sample="S1", **more):
    return {
        "operation_platform": "alpha", "project_name": "demo", "run_ext_id": None, "run_ext_src": None, "run_name": "run1",
        "run_instrument": "nova", "run_date": "2022-01-02 03:04:05", "job_start": None, "job_stop": None,
        "specimen": [{"specimen_name": "P1", "specimen_cohort": "C", "specimen_institution": "I", "sample": [{
            "sample_name": sample, "sample_tumour": False, **more, "readset": [{
                "experiment_sequencing_technology": None, "experiment_type": "WGS", "experiment_nucleic_acid_type": "DNA",
                "experiment_library_kit": None, "experiment_kit_expiration_date": None, "readset_name": r, "readset_lane": "1",
                "readset_adapter1": "A", "readset_adapter2": "B", "readset_sequencing_type": "PAIRED_END", "readset_quality_offset": "33",
                "file": [{"location_uri": f"alpha:///{r}.bam", "file_name": f"{r}.bam", "file_extra_metadata": {"read_type": "R1"}}],
                "metric": [{"metric_name": "yield", "metric_value": "1"}, {"metric_name": "yield", "metric_value": "1"}],
            } for r in readsets],
        }]}],
    }


def pipe_doc(entries, sample="S1"):
    """entries: (readset, job name, file md5, metric value)."""
    names = list(dict.fromkeys(e[0] for e in entries))
    return {
        "project_name": "DEMO", "operation_config_name": "cfg", "operation_config_version": "1", "operation_config_md5sum": "m",
        "operation_config_data": "a=1", "operation_platform": "alpha", "operation_cmd_line": "run", "operation_name": "ignored",
        "sample": [{"sample_name": sample, "readset": [{"readset_name": r, "job": [{
            "job_name": j, "job_start": "2022-01-01 00:00:00", "job_stop": None, "job_status": "COMPLETED" if md5 else None,
            "file": [{"location_uri": f"alpha:///{j}.txt", "file_name": f"{j}.txt", "file_md5sum": md5}],
            "metric": [{"metric_name": "q", "metric_value": v, "metric_flag": "PASS"}],
        } for rr, j, md5, v in entries if rr == r]} for r in names]}],
    }


@pytest.fixture(scope="module")
def loaded(spark, make, tmp_path_factory):
    """Tables after one run-processing report with two readsets."""
    base = make(project=[{"id": 7, "name": "DEMO"}])
    folder = put(tmp_path_factory.mktemp("run"), "a", run_doc(["R1", "R2"], sample_alias=["x", "x", "y"]))
    out = ingest.ingest_run_processing(base, read_run_processing(spark, folder), AS_OF)
    assert out.errors.count() == 0
    t = out.tables(base)
    path = str(tmp_path_factory.mktemp("catalog"))
    write_tables(spark, path, t)
    return load_tables(spark, path)


def test_run_processing(loaded):
    assert rows_of(loaded["specimen"], "name", "project_id", "cohort") == [("P1", 7, "C")]
    assert rows_of(loaded["sample"], "name", "alias", "tumour") == [("S1", ["x", "y"], False)]
    assert rows_of(loaded["readset"], "id", "name", "state", "experiment_id") == [(1, "R1", "VALID", 1), (2, "R2", "VALID", 1)]
    # No clock in the report: the job runs at the time of loading.
    assert [str(r["start"]) for r in loaded["job"].collect()] == [AS_OF]
    assert rows_of(loaded["file"], "name", "type", "deliverable", "extra_metadata") == [
        ("R1.bam", "bam", False, '{"read_type":"R1"}'), ("R2.bam", "bam", False, '{"read_type":"R1"}'),
    ]
    # Metrics are always inserted, equal ones too.
    assert loaded["metric"].count() == 4 and loaded["readset_metric"].count() == 4
    assert rows_of(loaded["readset_file"], "readset_id", "file_id") == [(1, 1), (2, 2)]


def test_bad_documents_are_left_out_whole(spark, loaded, tmp_path):
    put(tmp_path / "d", "a", run_doc(["R2", "R8"]))
    put(tmp_path / "d", "b", {**run_doc(["R9"]), "project_name": "none"})
    wrong = run_doc(["R10"])
    wrong["specimen"][0]["sample"][0]["readset"][0]["readset_lane"] = "99"
    put(tmp_path / "d", "c", wrong)
    put(tmp_path / "d", "d", run_doc(["R11"], sample="S2"))
    folder = put(tmp_path / "d", "e", run_doc(["R11", "R12"]))
    out = ingest.ingest_run_processing(loaded, read_run_processing(spark, folder), AS_OF)
    assert rows_of(out.errors, "doc", "code", "detail") == [
        (0, "name_taken", "R2"), (1, "project_missing", "none"), (2, "bad_value", "readset_lane=99"), (4, "name_repeated", "R11"),
    ]
    after = out.tables(loaded)
    assert rows_of(after["readset"], "name") == [("R1",), ("R11",), ("R2",)]
    assert rows_of(after["sample"], "id", "name") == [(1, "S1"), (2, "S2")]


def test_pipeline_twice_gives_a_warning_per_entry(spark, loaded, tmp_path):
    folder = put(tmp_path / "p", "a", pipe_doc([("R1", "trim", "a", "1"), ("R1", "merge", "b", "2"), ("R2", "merge", "b", "2"), ("R2", "off", None, "1")]))
    docs = read_pipeline_run(spark, folder)
    first = ingest.ingest_pipeline_run(loaded, docs, AS_OF)
    assert first.errors.count() == 0
    path = str(tmp_path / "catalog")
    write_tables(spark, path, first.tables(loaded))
    t = load_tables(spark, path)
    # The shared job is one job with both readsets; its file and location exist once.
    assert rows_of(t["job"].filter("id > 1"), "name") == [("merge",), ("trim",)]
    assert rows_of(t["file"].filter("id > 2"), "name", "type") == [("merge.txt", "txt"), ("trim.txt", "txt")]
    second = ingest.ingest_pipeline_run(t, docs, AS_OF)
    got = second.warning_rows().groupBy("code", "entity").count()
    assert rows_of(got, "code", "entity", "count") == [
        ("already_exists", "job", 3), ("already_exists", "location", 3), ("already_exists", "operation", 1),
        ("already_exists", "operation_config", 1), ("job_without_status", "readset", 1),
    ]
    again = second.tables(t)
    for name in again:
        assert again[name].count() == t[name].count(), name


def test_pipeline_document_errors(spark, loaded, tmp_path):
    put(tmp_path / "p", "a", pipe_doc([("R1", "trim", "a", "1")], sample="nobody"))
    put(tmp_path / "p", "b", pipe_doc([("R7", "trim", "a", "1")]))
    put(tmp_path / "p", "c", pipe_doc([("R1", "trim", None, "1")]))
    folder = put(tmp_path / "p", "d", {**pipe_doc([]), "sample": []})
    out = ingest.ingest_pipeline_run(loaded, read_pipeline_run(spark, folder), AS_OF)
    assert rows_of(out.errors, "doc", "code") == [(0, "sample_missing"), (1, "readset_missing"), (2, "no_job_status"), (3, "no_sample")]
    assert out.tables(loaded)["job"].count() == 1


def test_changed_values_replace_across_documents(spark, loaded, tmp_path):
    put(tmp_path / "p", "a", pipe_doc([("R1", "merge", "a", "1")]))
    put(tmp_path / "p", "b", pipe_doc([("R2", "merge", "b", "1")]))
    folder = put(tmp_path / "p", "c", pipe_doc([("R2", "merge", "a", "2")]))
    t = ingest.ingest_pipeline_run(loaded, read_pipeline_run(spark, folder), AS_OF).tables(loaded)
    files = t["file"].filter("name = 'merge.txt'")
    assert rows_of(files, "id", "md5sum", "deprecated") == [(3, "a", True), (4, "b", True), (5, "a", False)]
    assert rows_of(t["metric"].filter("name = 'q'"), "id", "value", "deprecated") == [(5, "1", True), (6, "2", False)]
    # The one uri ends with the file of the last document.
    assert rows_of(t["location"].filter("uri = 'alpha:///merge.txt'"), "file_id") == [(5,)]
    assert rows_of(t["readset_metric"].filter("metric_id = 5"), "readset_id") == [(1,), (2,)]


@pytest.mark.parametrize("seed", range(4))
def test_metric_versions_equal_a_loop(spark, make, monkeypatch, seed):
    monkeypatch.setattr(g, "BUCKET_DOCS", 4)
    rng = random.Random(seed)
    stored = {}
    for job in (1, 2, 3):
        if rng.random() < 0.8:
            stored[(job, "m")] = (len(stored) + 1, rng.choice(["a", "b", None]))
    t = make(
        metric=[{"id": i, "job_id": k[0], "name": "m", "value": v} for k, (i, v) in stored.items()],
        readset_metric=[{"readset_id": 1, "metric_id": i} for i, _ in stored.values()],
    )
    data = [(n, rng.choice([1, 1, 1, 2]), rng.randrange(1, 4), rng.choice(["a", "b", None])) for n in range(25)]
    df = spark.createDataFrame(data, "doc long, job_id long, readset_id long, value string").select(
        "job_id", "readset_id", "value", F.lit("m").alias("name"), F.lit(None).cast("string").alias("flag"),
        F.lit(False).alias("deliverable"), F.struct("doc").alias("pos"),
    )
    v = version_metrics(t, df, moment(AS_OF))
    active = {k: i for k, (i, _) in stored.items()}
    values = {i: val for i, val in stored.values()}
    gone, links, top = set(), set(), len(stored)
    for _, job, readset, value in data:
        cur = active.get((job, "m"))
        if cur is None or values[cur] != value:
            if cur is not None:
                gone.add(cur)
            top += 1
            values[top] = value
            active[(job, "m")] = cur = top
        links.add((readset, cur))
    got = {r["id"]: (r["value"], r["deprecated"]) for r in v.new.collect()}
    assert got == {i: (val, i in gone) for i, val in values.items() if i > len(stored)}
    assert {r["id"] for r in v.deprecated.collect()} == {i for i in gone if i <= len(stored)}
    assert {(r["readset_id"], r["metric_id"]) for r in v.rows.collect()} == links


def test_rows_before_the_first_match_are_deprecated(spark, make):
    t = make(
        metric=[{"id": i, "job_id": 1, "name": "m", "value": v} for i, v in ((1, "a"), (2, "b"), (3, "c"))],
        readset_metric=[{"readset_id": 1, "metric_id": i} for i in (1, 2, 3)],
    )
    df = spark.createDataFrame([(1, 1, "b", "m")], "job_id long, readset_id long, value string, name string").select(
        "*", F.lit(None).cast("string").alias("flag"), F.lit(False).alias("deliverable"), F.struct(F.lit(0).alias("doc")).alias("pos")
    )
    v = version_metrics(t, df, moment(AS_OF))
    assert v.new.count() == 0 and rows_of(v.deprecated, "id") == [(1,)] and rows_of(v.rows, "metric_id") == [(2,)]


def move(readset, pairs, **more):
    return {
        "operation_platform": "alpha", "operation_cmd_line": "cp", "job_end": "2022-01-01 00:00:00", **more,
        "readset": [{"readset_name": readset, "file": [{"src_location_uri": a, "dest_location_uri": b} for a, b in pairs]}],
    }


def test_transfer_and_delivery(spark, loaded, tmp_path):
    folder = put(tmp_path / "t", "a", move("R1", [("alpha:///R1.bam", "bravo:///R1.bam")]))
    put(tmp_path / "t", "b", move("R1", [("alpha:///R2.bam", "bravo:///R2.bam")]))
    out = ingest.ingest_transfer(loaded, read_transfer(spark, folder), AS_OF, project="demo")
    # The file of another readset is not found under this name.
    assert rows_of(out.errors, "doc", "code", "detail") == [(1, "source_missing", "alpha:///R2.bam")]
    path = str(tmp_path / "catalog")
    write_tables(spark, path, out.tables(loaded))
    t = load_tables(spark, path)
    assert rows_of(t["location"], "uri", "file_id", "endpoint") == [
        ("alpha:///R1.bam", 1, "alpha"), ("alpha:///R2.bam", 2, "alpha"), ("bravo:///R1.bam", 1, "bravo"),
    ]
    loose = ingest.ingest_transfer(loaded, read_transfer(spark, folder), AS_OF, "demo", check_readset_name=False)
    assert loose.errors.count() == 0 and loose.inserts["location"].count() == 2

    folder = put(tmp_path / "v", "a", move("R1", [("bravo:///R1.bam", "out:///R1.bam")]))
    put(tmp_path / "v", "b", move("R2", [("alpha:///R2.bam", "bravo:///R1.bam")], delete=False))
    done = ingest.ingest_delivery(t, read_delivery(spark, folder), AS_OF, "demo")
    after = done.tables(t)
    # Deleted as a source first, revived as a destination after; it stays with its old file.
    assert rows_of(after["location"], "uri", "file_id", "deleted") == [
        ("alpha:///R1.bam", 1, False), ("alpha:///R2.bam", 2, False), ("bravo:///R1.bam", 1, False), ("out:///R1.bam", 1, False),
    ]
    assert rows_of(after["file"], "id", "state") == [(1, "DELIVERED"), (2, "DELIVERED")]
    only = ingest.ingest_delivery(t, read_delivery(spark, str(tmp_path / "v" / "a.json")), AS_OF, "demo").tables(t)
    assert rows_of(only["location"].filter("deleted"), "uri") == [("bravo:///R1.bam",)]


def test_run_processing_revives_and_moves_a_known_uri(spark, make, tmp_path):
    base = make(
        project=[{"id": 1, "name": "DEMO"}], file=[{"id": 1, "name": "old"}],
        location=[{"id": 1, "file_id": 1, "uri": "alpha:///R1.bam", "endpoint": "alpha", "deleted": True}],
    )
    folder = put(tmp_path / "d", "a", run_doc(["R1"]))
    t = ingest.ingest_run_processing(base, read_run_processing(spark, folder), AS_OF).tables(base)
    assert rows_of(t["location"], "id", "file_id", "deleted") == [(1, 2, False)]


def test_stream_over_a_growing_folder_equals_one_batch(spark, loaded, tmp_path):
    sink, drop = str(tmp_path / "sink"), tmp_path / "in"
    write_tables(spark, sink, loaded)
    for name, readset in (("a", "R1"), ("b", "R2")):
        put(drop, name, move(readset, [(f"alpha:///{readset}.bam", f"bravo:///{readset}.bam")]))
        stream = stream_ingest(spark, str(drop), "transfer", sink, str(tmp_path / "ck"), as_of=AS_OF, project="demo")
        stream.awaitTermination()
    streamed = load_tables(spark, sink)
    whole = ingest.ingest_transfer(loaded, read_transfer(spark, str(drop)), AS_OF, "demo").tables(loaded)
    assert rows_of(streamed["location"], "uri", "file_id") == rows_of(whole["location"], "uri", "file_id")
    assert rows_of(streamed["readset_job"], "readset_id", "job_id") == rows_of(whole["readset_job"], "readset_id", "job_id")
    assert rows_of(streamed["job_file"], "job_id", "file_id") == rows_of(whole["job_file"], "job_id", "file_id")


CHAIN = [("alpha:///R1.bam", "bravo:///R1.bam"), ("bravo:///R1.bam", "cold:///R1.bam"), ("cold:///R1.bam", "dock:///R1.bam")]


def test_moves_that_build_on_each_other_do_not_depend_on_batches(spark, loaded, tmp_path):
    folder = None
    for n, pair in enumerate(CHAIN):
        folder = put(tmp_path / "t", f"{n}", move("R1", [pair]))
    put(tmp_path / "t", "3", move("R2", [CHAIN[0]]))  # another readset's file
    put(tmp_path / "t", "4", move("R2", [("alpha:///R2.bam", "bravo:///R2.bam"), ("lost:///x", "bravo:///x")]))
    put(tmp_path / "t", "5", move("R2", [("bravo:///R2.bam", "cold:///R2.bam")]))  # builds on a refused report
    put(tmp_path / "t", "6", move("R2", [("alpha:///R2.bam", "echo:///R2.bam"), ("echo:///R2.bam", "fox:///R2.bam")]))
    out = ingest.ingest_transfer(loaded, read_transfer(spark, folder), AS_OF, "demo")
    assert rows_of(out.errors, "doc", "detail") == [(3, "alpha:///R1.bam"), (4, "lost:///x"), (5, "bravo:///R2.bam")]
    once = rows_of(out.tables(loaded)["location"], "uri", "file_id", "deleted")
    t = loaded
    for part in ("[0-1]", "[2-6]"):
        t = ingest.ingest_transfer(t, read_transfer(spark, f"{folder}/{part}.json"), AS_OF, "demo").tables(t)
    assert rows_of(t["location"], "uri", "file_id", "deleted") == once and len(once) == 7


def test_deliveries_that_build_on_each_other_leave_the_last_place(spark, loaded, tmp_path):
    for n, pair in enumerate(CHAIN):
        folder = put(tmp_path / "d", f"{n}", move("R1", [pair]))
    once = ingest.ingest_delivery(loaded, read_delivery(spark, folder), AS_OF, "demo").tables(loaded)
    t = loaded
    for part in ("0", "[1-2]"):
        t = ingest.ingest_delivery(t, read_delivery(spark, f"{folder}/{part}.json"), AS_OF, "demo").tables(t)
    rows = rows_of(once["location"].filter("file_id = 1"), "uri", "deleted")
    assert rows == rows_of(t["location"].filter("file_id = 1"), "uri", "deleted")
    assert [u for u, gone in rows if not gone] == ["dock:///R1.bam"]


def test_unreadable_dates_are_refused_and_absent_ones_are_not(spark, loaded, tmp_path):
    good, bad = run_doc(["R8"], "S8"), run_doc(["R9"], "S9")
    bad["job_start"] = "not a date"
    put(tmp_path / "r", "a", good)
    folder = put(tmp_path / "r", "b", bad)
    out = ingest.ingest_run_processing(loaded, read_run_processing(spark, folder), AS_OF, "demo")
    assert rows_of(out.errors, "doc", "code", "detail") == [(1, "bad_date", "job_start=not a date")]
    folder = put(tmp_path / "t", "a", move("R1", [CHAIN[0]], job_stop="2022-13-01 00:00:00"))
    out = ingest.ingest_transfer(loaded, read_transfer(spark, folder), AS_OF, "demo")
    assert rows_of(out.errors, "code", "detail") == [("bad_date", "job_stop=2022-13-01 00:00:00")]


def test_two_folders_stream_into_one_catalog(spark, loaded, tmp_path):
    sink = str(tmp_path / "sink")
    write_tables(spark, sink, loaded)
    for readset in ("R1", "R2"):
        drop = tmp_path / f"in-{readset}"
        put(drop, "a", move(readset, [(f"alpha:///{readset}.bam", f"bravo:///{readset}.bam")]))
        for _ in range(2):  # the second start finds nothing new
            stream_ingest(spark, str(drop), "transfer", sink, str(tmp_path / f"ck-{readset}"), as_of=AS_OF, project="demo").awaitTermination()
    got = rows_of(load_tables(spark, sink)["location"].filter("endpoint = 'bravo'"), "uri", "file_id")
    assert got == [("bravo:///R1.bam", 1), ("bravo:///R2.bam", 2)]
    assert load_tables(spark, sink, 1)["location"].count() == 2


def test_a_version_is_written_once(spark, loaded, tmp_path, monkeypatch):
    from seqledger.sources import tables

    path = str(tmp_path / "c")
    write_tables(spark, path, loaded)
    monkeypatch.setattr(tables, "manifest", lambda *a: None)  # a writer that has not seen version 1
    with pytest.raises(tables.ConflictError):
        write_tables(spark, path, {"project": loaded["project"]})


KINDS = {"run_processing": ("specimen", ingest.ingest_run_processing), "transfer": ("readset", ingest.ingest_transfer),
         "pipeline_run": ("sample", ingest.ingest_pipeline_run), "delivery": ("readset", ingest.ingest_delivery)}


@pytest.mark.parametrize("kind", list(KINDS))
def test_unreadable_files_are_refused_and_insert_nothing(spark, loaded, tmp_path, kind):
    level, load = KINDS[kind]
    folder = tmp_path / kind
    folder.mkdir()
    bad = {"a.json": '{"project_name": "demo", "%s": [' % level, "b.json": '{"project_name": "demo", "%s": 7}' % level, "c.json": "",
           "d.json": " \n\t", "e.json": '"text"', "g.json": "no json"}
    for name, text in bad.items():
        (folder / name).write_text(text)
    (folder / "z.json").write_text("[]")
    docs = read_envelopes(spark, str(folder), kind)
    out = load(loaded, docs, AS_OF, project="demo")
    errors = out.errors.join(out.docs, "doc").collect()
    assert {(r["source"].rsplit("/", 1)[1], r["code"], r["entity"]) for r in errors} == {(n, "unreadable", "document") for n in bad}
    assert all(df.count() == 0 for df in out.inserts.values()) and all(df.count() == 0 for df in out.updates.values())
    kept = {r["source"].rsplit("/", 1)[1]: r for r in quarantine(docs).collect()}
    assert set(kept) == set(bad) and kept["a.json"]["text"] == bad["a.json"] and kept["c.json"]["n_chars"] == 0
