"""Group helpers against plain loops, with tiny buckets and parts."""

import random

import pytest
from pyspark.sql import functions as F

from seqledger.operators import grouping as g


@pytest.fixture
def small_buckets(monkeypatch):
    monkeypatch.setattr(g, "BUCKET_DOCS", 3)


def items(spark, seed):
    rng = random.Random(seed)
    data = [(rng.choice("kkkx"), rng.choice(["a", "b", None]), n, rng.randrange(3)) for n in range(40)]
    data = list({(k, n, b): (k, v, n, b) for k, v, n, b in data}.values())
    df = spark.createDataFrame(data, "k string, v string, doc long, b int")
    return data, df.withColumn("pos", F.struct("doc", "b"))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_change_runs(spark, small_buckets, seed):
    data, df = items(spark, seed)
    want, run, last = {}, {}, {}
    for k, v, n, b in sorted(data, key=lambda r: (r[2], r[3])):
        if k not in run or last[k] != v:
            run[k] = run.get(k, 0) + 1
        last[k] = v
        want[(k, n, b)] = run[k]
    got = {(r["k"], r["doc"], r["b"]): r["run"] for r in g.change_runs(df, ["k"], "v").collect()}
    assert got == want


@pytest.mark.parametrize("seed", [4, 5])
def test_previous_value(spark, small_buckets, seed):
    data, df = items(spark, seed)
    want, last = {}, {}
    for k, v, n, b in sorted(data, key=lambda r: (r[2], r[3])):
        want[(k, n, b)] = last.get(k)
        last[k] = (v,)
    rows = g.previous_value(df, ["k"], "v").collect()
    got = {(r["k"], r["doc"], r["b"]): None if r["previous"] is None else (r["previous"]["v"],) for r in rows}
    assert got == want


def test_allocate_ids_follows_document_order(spark, small_buckets):
    rows = spark.createDataFrame([(d, n) for d in range(20) for n in range(d % 3)], "doc long, n int")
    rows = rows.withColumn("pos", F.struct("doc", "n")).repartition(7)
    existing = spark.createDataFrame([(41,)], "id long")
    got = sorted((tuple(r["pos"]), r["id"]) for r in g.allocate_ids(rows, existing).collect())
    assert [i for _, i in got] == list(range(42, 42 + len(got)))


def test_number_documents(spark):
    df = spark.createDataFrame([(f"f{n:04d}",) for n in range(500)], "source string").repartition(5)
    rows = g.number_documents(df, "source").collect()
    assert {r["source"]: r["doc"] for r in rows} == {f"f{n:04d}": n for n in range(500)}


def test_repeat_rows(spark):
    df = spark.createDataFrame([("a", 25), ("b", 1), ("c", 10)], "k string, n long")
    got = {r["k"]: r["count"] for r in g.repeat_rows(df, "n", chunk=10).groupBy("k").count().collect()}
    assert got == {"a": 25, "b": 1, "c": 10}


def test_remap_links_folds_into_existing(spark):
    link = spark.createDataFrame([(1, 10), (1, 11), (2, 11), (2, 12)], "r long, f long")
    mapping = spark.createDataFrame([(10, 10), (11, 10), (12, 10)], "old_id long, new_id long")
    assert sorted(map(tuple, g.remap_links(link, mapping, "f").collect())) == [(1, 10), (2, 10)]
