"""Plans and files that decide how steps grow with the input."""

from pathlib import Path

from pyspark.sql import functions as F

from seqledger import session
from seqledger.operators import cleanup
from seqledger.operators import grouping as g
from seqledger.operators import validate
from seqledger.operators.ingest import base
from seqledger.plans import ingest_queries, reports
from seqledger.sources import tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_reports_are_written_compressed(spark):
    rows = spark.range(20_000).select(F.lit("x" * 80).alias("name"), F.lpad(F.col("id").cast("string"), 14, "0").alias("source"))
    path = reports.write_reports(rows, ["name"])
    assert sum(p.stat().st_size for p in Path(path).glob("part-*")) < 20_000 * 30
    assert spark.read.schema("name string, source string").json(path).distinct().count() == 20_000
    bad = reports.damaged(spark, path, "level")
    assert sum(p.stat().st_size for p in Path(bad).glob("part-*")) < 20_000 * 30
    assert spark.read.text(bad).count() == 20_000


def test_documents_are_moved_once(spark):
    docs = spark.range(500).select(F.concat(F.lit("f"), 1000 + F.col("id")).alias("source"), F.lit("x").alias("text")).repartition(7)
    out = g.number_documents(docs, "source", keep_order=False)
    assert out.columns == ["text", "doc"] and "Window" not in plan(out) and "hashpartitioning" not in plan(out)
    assert sorted(r["doc"] for r in out.collect()) == list(range(500))


def test_a_document_has_a_row_for_each_project_of_its_name(spark, make):
    t = make(project=[{"id": 1, "name": "A"}, {"id": 2, "name": "A"}, {"id": 3, "name": "B", "deleted": True}, {"id": 4, "name": "C"}])
    docs = spark.createDataFrame([("s1", "a"), ("s2", "b"), ("s3", None), ("s4", "c")], "source string, project_name string")
    out = base.numbered(t, docs, None)
    assert sorted((r["doc"], r["project_id"]) for r in out.filter("project_id > 0").collect()) == [(0, 1), (0, 2), (3, 4)]
    assert sorted(r["doc"] for r in out.filter("project_id is null").collect()) == [1, 2]
    assert sorted(r["source"] for r in base.once(out).collect()) == ["s1", "s2", "s3", "s4"]


def test_tables_that_compress_well_are_not_sent_to_all_tasks(spark, make):
    """Only a table that is counted to be small is; the files of the others say little of their rows."""
    few, many = spark.range(50), spark.range(3 * session.BROADCAST_ROWS)
    for rows, sent in ((few, True), (many, False)):
        kept = session.cut(rows.select("id", F.lit("x" * 200).alias("name")), "side")
        joined = many.withColumnRenamed("id", "k").join(session.side(kept), F.col("k") == F.col("id"))
        assert ("BroadcastHashJoin" in plan(joined)) is sent
        asked = kept.select(F.concat("name", "id").alias("name"), F.struct(F.col("id").alias("doc"), *[F.lit(0).alias(c) for c in "abcd"]).alias("pos"))
        found = base.get_or_create(make()["sample"], session.cut(asked, "asked"), "sample", ("name",), base.moment("2024-01-01"))
        assert ("BroadcastHashJoin" in plan(found.rows)) is sent
        assert found.rows.filter("first").count() == found.new.count() == rows.count()


def test_loaded_tables_are_merged_in_the_pipeline_queries(spark, make, monkeypatch):
    """Their files are small however many rows they have; only operations and projects may be sent to all tasks."""
    n = make(
        project=[{"id": 1, "name": "A"}], operation=[{"id": 2, "project_id": 1}], readset=[{"id": 3, "name": "r"}, {"id": 4, "name": "q"}],
        job=[{"id": 5, "operation_id": 2, "name": "trim.r"}, {"id": 6, "operation_id": 2, "name": "merge"}],
        file=[{"id": 7, "name": "r.trim.fastq.gz", "type": "fastq.gz", "md5sum": "x"}, {"id": 8, "name": "summary.txt", "type": "txt", "md5sum": "y"}],
        metric=[{"id": 9, "name": "reads", "job_id": 5, "value": "3"}, {"id": 10, "name": "merged", "job_id": 6, "value": "0"}],
        location=[{"id": 11, "file_id": 7, "uri": "alpha:///trim/r"}, {"id": 12, "file_id": 8, "uri": "alpha:///merge/summary.txt"}],
        readset_file=[{"readset_id": 3, "file_id": 7}, {"readset_id": 3, "file_id": 8}, {"readset_id": 4, "file_id": 8}],
        readset_metric=[{"readset_id": 3, "metric_id": 9}, {"readset_id": 3, "metric_id": 10}, {"readset_id": 4, "metric_id": 10}],
        job_file=[{"job_id": 5, "file_id": 7}, {"job_id": 6, "file_id": 8}], readset_job=[{"readset_id": 3, "job_id": 5}, {"readset_id": 3, "job_id": 6}],
    )
    n = {k: session.cut(v, k) if v.count() else v for k, v in n.items()}
    monkeypatch.setattr(reports, "loaded_pipelines", lambda t: (None, t))
    wanted = {
        "pipeline_own_files": (0, ("r", "trim.r", "r.trim.fastq.gz", "trim.fastq.gz", "fastq.gz", "alpha:///trim/r", "3")),
        "pipeline_shared_location": (0, ("alpha:///merge/summary.txt", "y")),
        "pipeline_metric_versions": (2, ("A", "0", False, 2)), "pipeline_file_versions": (2, ("A", "y", False, 2)),
    }
    for name, (sent, row) in wanted.items():
        out = getattr(ingest_queries, name)(n)
        assert plan(out).count("BroadcastHashJoin") <= sent, name
        assert [tuple(r) for r in out.collect()] == [row], name


def test_buckets_of_a_key_are_chained_by_merging(spark):
    """They are as many as the keys, however small the files of the rows are (F14, F17)."""
    pos = F.struct(F.col("id").alias("doc"), *[F.lit(0).alias(c) for c in "abcd"]).alias("pos")
    value = F.floor(F.col("id") / 100).cast("string")
    rows = session.cut(spark.range(900).select(pos, (F.col("id") % 3).alias("job_id"), F.lit("m").alias("name"), value.alias("value")), "rows")
    runs, before = g.change_runs(rows, ["job_id", "name"], "value"), g.previous_value(rows, ["job_id", "name"], "value")
    for out in (runs, before):
        assert "SortMergeJoin" in plan(out) and "Broadcast" not in plan(out)
    assert {(r["pos"]["doc"], r["run"]) for r in runs.collect()} == {(i, 1 + i // 100) for i in range(900)}
    assert {(r["pos"]["doc"], r["previous"] and r["previous"]["v"]) for r in before.collect()} == {(i, str((i - 3) // 100) if i > 2 else None) for i in range(900)}
    ids = g.allocate_ids(rows, spark.createDataFrame([(7,)], "id long"))
    assert ids.columns == [*rows.columns, "id"] and "SortMergeJoin" in plan(ids) and "Broadcast" not in plan(ids)
    assert {(r["pos"]["doc"], r["id"]) for r in ids.collect()} == {(i, i + 8) for i in range(900)}


def test_samples_and_files_are_merged_into_the_reports(spark, make, monkeypatch):
    """Both grow with the data (F14, F17)."""
    t = make(
        project=[{"id": 1, "name": "A"}], specimen=[{"id": 2, "name": "S", "project_id": 1}], experiment=[{"id": 3}], run=[{"id": 4, "name": "u"}],
        sample=[{"id": 5, "name": "s", "specimen_id": 2}], readset=[{"id": 6, "name": "r", "sample_id": 5, "experiment_id": 3, "run_id": 4}],
        file=[{"id": 7, "name": "f"}], readset_file=[{"readset_id": 6, "file_id": 7}],
    )
    t = {k: session.cut(v, k) if v.count() else v for k, v in t.items()}
    made = []
    monkeypatch.setattr(reports, "write_reports", lambda rows, fields: made.append(rows))
    reports.run_processing_reports(t), reports.move_reports(t, "a", "b"), reports.pipeline_reports(t)
    assert len(made) == 3
    for rows in made:
        sent = [x for x in plan(rows).splitlines() if "BroadcastHashJoin" in x]
        assert not [x for x in sent if "sample_id" in x or "file_id" in x]
        assert [(r["readset_name"], r["sample_name"], r["project_name"]) for r in rows.collect()] == [("r", "s", "A")]


def test_copies_are_made_in_many_tasks_and_after_the_joins(spark, make):
    """Chunks are few and small however many rows they stand for (F22)."""
    few = spark.range(200).select("id", F.lit(3).cast("bigint").alias("n"))
    made = g.repeat_rows(few, "n", chunk=2)
    assert made.count() == 600
    assert made.select(F.spark_partition_id()).distinct().count() > 1
    t = make(
        job=[{"id": 1}, {"id": 2}], readset_job=[{"readset_id": 1, "job_id": 1}, {"readset_id": 7, "job_id": 2}],
        metric=[{"id": i, "name": "m", "value": "1" if i < 3 else str(i)} for i in range(1, 6)],
        readset_metric=[{"readset_id": 1, "metric_id": i} for i in range(1, 6)],
    )
    rows = cleanup.relink_jobs_to_kept(t)
    text = plan(rows)
    assert 0 < text.index("Generate") < text.index("Join")
    assert [(r["keep_metric_id"], r["job_id"]) for r in rows.collect()] == [(1, 1)] * 3


def test_loose_rescue_moves_numbers_and_no_names(spark, make):
    """Links find their files by the number of a name and operation; jobs and files are joined once (F27)."""
    t = make(
        file=[{"id": i, "name": n} for i, n in ((1, "a"), (2, "a"), (3, "a"), (4, "a"), (5, "b"), (6, None), (7, "c"))],
        location=[{"id": 20 + i, "file_id": i, "uri": u} for i, u in ((2, "x:///a"), (3, "y:///d/a"), (3, None), (4, "x:///z"), (7, None))],
        job=[{"id": 10, "operation_id": 5}, {"id": 11, "operation_id": 5}, {"id": 12, "operation_id": 6}],
        job_file=[{"job_id": j, "file_id": f} for j, f in ((10, 1), (10, 1), (11, 2), (11, 3), (11, 4), (12, 5), (12, 6), (11, 7))],
        readset_file=[{"readset_id": r, "file_id": f} for r, f in ((1, 1), (1, 1), (2, 1), (2, 3), (3, 5), (3, 6), (4, 7))],
    )
    out = cleanup.rescue_loose(t)
    assert "name" not in plan(out["readset_file"])
    assert sorted(tuple(r) for r in out["readset_file"].collect()) == [(1, 2), (1, 3), (2, 2), (2, 3), (3, 5), (3, 6), (4, 7)]
    assert sorted(r["id"] for r in out["file"].collect()) == [2, 3, 4, 5, 6, 7]
    assert sorted(tuple(r) for r in out["job_file"].collect()) == [(11, 2), (11, 3), (11, 4), (11, 7), (12, 5), (12, 6)]


def test_cleanup_reads_shared_tables_once_and_links_without_json(spark, make, monkeypatch):
    """Links are compared by their keys; tables that several steps read are written first (F21)."""
    t = make(readset_file=[{"readset_id": 1, "file_id": f} for f in (1, 2, 2)], operation=[{"id": 1}, {"id": 2}], job=[{"id": 3, "operation_id": 1}])
    after = t["readset_file"].filter("file_id = 1").union(spark.createDataFrame([(9, 9)], t["readset_file"].schema))
    report = cleanup.cleanup_report("step", {"readset_file": t["readset_file"]}, {"readset_file": after})
    assert "json" not in plan(report).lower()
    assert [tuple(r) for r in report.collect()] == [("step", "readset_file", 3, 2, 2, 1)]
    labels = []
    monkeypatch.setattr(cleanup, "CLEANUP_STEPS", cleanup.CLEANUP_STEPS[4:5])
    monkeypatch.setattr(cleanup, "cut", lambda df, label: labels.append(label) or session.cut(df, label))
    report = cleanup.cleanup_all(t)[1]
    assert {"job", "job_file", "readset_file", "metric"} <= set(labels[:8])
    assert [tuple(r) for r in report.collect()] == [("drop_orphan_operations", "operation", 2, 1, 1, 0)]


def test_documents_are_parsed_once_and_compared_only_where_sources_repeat(spark, monkeypatch):
    """Finding the ranges of an order reads its documents before they are moved (F1 to F19)."""
    labels = []
    monkeypatch.setattr(base, "cut", lambda df, label: labels.append(label) or session.cut(df, label))
    docs = spark.createDataFrame([("s2", "b"), ("s1", "z"), ("s3", "c")], "source string, text string")
    ordered = base._ordered(docs)
    assert labels == ["read"] and "md5" not in plan(ordered)
    assert [(r["doc"], r["text"]) for r in base.number(docs).orderBy("doc").collect()] == [(0, "z"), (1, "b"), (2, "c")]
    twice = docs.union(spark.createDataFrame([("s1", "a"), (None, "n")], docs.schema))
    assert "md5" in plan(base._ordered(twice))
    assert {(r["doc"] < 3, r["source"]) for r in base.number(twice).collect()} == {(True, None), (True, "s1"), (False, "s2"), (False, "s3")}


def test_ids_of_list_items_come_from_the_lengths_of_the_lists(spark):
    """They are those that the items would get one by one, and no item is moved (F1 to F16)."""
    pos = F.struct(F.col("id").alias("doc"), *[F.lit(0).alias(c) for c in "abcd"]).alias("pos")
    rows = session.cut(spark.range(1500).repartition(5).select("id", pos, (F.col("id") % 4).alias("n"), F.lit(1).alias("m")), "lists")
    out = g.allocate_ranges(rows, {"n": spark.createDataFrame([(7,)], "id long"), "m": tables.empty_tables(spark)["metric"]})
    items = out.filter("n_start is not null").join(rows.select("id", "n"), "id").withColumn("d", F.explode(F.sequence(F.lit(1), F.greatest("n", F.lit(1)))))
    got = {(r["id"], r["d"]): r["n_start"] + r["d"] for r in items.filter("n > 0").collect()}
    want = [(i, d) for i in range(1500) for d in range(1, i % 4 + 1)]
    assert got == {x: 8 + k for k, x in enumerate(want)}
    assert all(r["m_start"] == r["id"] for r in out.collect())


def test_rows_of_large_tables_are_matched_once(spark, make, monkeypatch):
    """Warnings and the next step read written rows; of places only those are looked at that come again (F1 to F19)."""
    monkeypatch.setattr(session, "BROADCAST_ROWS", 5)
    names = [*(f"n{i}" for i in range(40)), "n1", None, None]
    asked = spark.createDataFrame([((i, 0, 0, 0, 0), x, i) for i, x in enumerate(names)], "pos struct<doc:bigint,a:int,b:int,c:int,d:int>, name string, specimen_id long")
    t = make(sample=[{"id": 3, "name": "n2"}, {"id": 2, "name": "n2"}, {"id": 4, "name": "n3", "deleted": True}])
    found = base.get_or_create(t["sample"], session.cut(asked, "asked"), "sample", ("name",), base.moment("2024-01-01"), ("specimen_id",))
    assert "Join" not in plan(found.rows) and found.rows.count() == 43 and found.new.count() == 40
    again = {("n1", 40), ("n2", 2), (None, 42)}
    assert {(r["name"], r["pos"]["doc"]) for r in found.repeats.collect()} == again
    few = base.get_or_create(t["sample"], session.cut(asked, "asked"), "sample", ("name",), base.moment("2024-01-01"), ("specimen_id",), every=False)
    assert {(r["name"], r["pos"]["doc"], r["first"]) for r in few.rows.collect()} == {(*x, False) for x in again} | {("n1", 1, True), (None, 41, True)}
    assert {(r["name"], r["made"]["specimen_id"]) for r in few.repeats.filter("is_new").collect()} == {("n1", 1), (None, 41)}


def test_names_that_come_once_and_empty_tables_cost_no_join(spark):
    """(F1 to F19)"""
    rows = session.cut(spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 3), ("c", 3), (None, 4), (None, 5)], "name string, doc long"), "names")
    out = validate.repeated_names(rows)
    assert "SortMergeJoin" not in plan(out)
    assert sorted(tuple(r) for r in out.collect()) == [("b", 2), ("c", 3)]
    empty = tables.empty_tables(spark)
    assert [f.name for f in empty["file"].schema] == empty["file"].columns and "Exchange" not in plan(rows.join(empty["sample"].hint("merge"), "name", "left"))


def test_last_run_of_a_key_is_known_with_its_runs(spark):
    pos = F.struct(F.col("id").alias("doc"), *[F.lit(0).alias(c) for c in "abcd"]).alias("pos")
    rows = spark.range(900).select(pos, F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"), F.floor(F.col("id") / 100).alias("v"))
    out = g.change_runs(rows, ["k"], "v", last="n")
    assert out.columns == ["pos", "k", "v", "run", "n"]
    assert {(r["pos"]["doc"], r["run"], r["n"]) for r in out.collect()} == {(i, 1 + i // 100, 9) for i in range(900)}
