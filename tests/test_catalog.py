"""The bucketed catalog: what a version writes, what the older ones still hold."""

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from seqledger.sources import changed_buckets, load_rows, load_tables, write_changes, write_tables
from seqledger.sources import tables as catalog


def places(make, ids, **more):
    return make(location=[{"id": i, "uri": f"u{i}", "endpoint": "e", **more} for i in ids])["location"]


def written(spark, base, version):
    return sorted((r["name"], r["bucket"]) for r in changed_buckets(spark, base, version).filter("written").collect())


def test_an_update_rewrites_the_buckets_of_its_rows_alone(spark, make, tmp_path):
    base = str(tmp_path / "c")
    write_tables(spark, base, {"location": places(make, range(40)), "file": make(file=[{"id": 1, "name": "f"}])["file"]}, buckets=8)
    second = write_changes(spark, base, updated={"location": places(make, [3, 11, 100], deleted=True)})
    # An id that is not stored is no row to replace; bucket 4 has no other change.
    assert written(spark, base, second) == [("location", 3), ("location", 4)]
    new, old = load_tables(spark, base), load_tables(spark, base, 1)
    assert rows_of(new["location"].filter("deleted"), "id") in ([(11,), (3,)], [(100,), (11,), (3,)])
    assert old["location"].count() == 40 and old["location"].filter("deleted").count() == 0
    assert rows_of(new["file"], "name") == [("f",)] and new["metric"].count() == 0


def test_added_rows_lie_beside_the_others_until_many_are_merged(spark, make, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "MERGE_AT", 3)
    base = str(tmp_path / "c")
    for i in range(5):
        write_changes(spark, base, appended={"location": places(make, [i * 4, i * 4 + 1]), "job_file": make(job_file=[{"job_id": i, "file_id": 7}])["job_file"]}, buckets=4)
    files = {r["bucket"]: r["files"] for r in changed_buckets(spark, base, 5).filter("name = 'location'").collect()}
    assert set(files) == {0, 1} and all(n < 3 for n in files.values())
    for version, n in ((5, 10), (3, 6), (1, 2)):
        t = load_tables(spark, base, version)
        assert t["location"].count() == t["location"].select("id").distinct().count() == n and t["job_file"].count() == n // 2


def test_rows_by_key_come_from_their_buckets(spark, make, tmp_path):
    base = str(tmp_path / "c")
    write_tables(spark, base, {"location": places(make, range(64))})
    some = load_rows(spark, base, "location", [5, 21, 99])
    assert rows_of(some, "id") == [(21,), (5,)] and {f.split("bucket_=")[1].split("/")[0] for f in some.inputFiles()} == {"5", "3"}
    assert load_rows(spark, base, "metric", [1]).count() == 0


def test_versions_are_found_by_name_and_batches_by_stream(spark, make, tmp_path):
    base = str(tmp_path / "c")
    assert catalog.manifest(spark, base) is None and not catalog.batch_written(spark, base, "s", 0)
    with pytest.raises(LookupError):
        load_tables(spark, base, 1)
    for i in range(3):
        write_changes(spark, base, appended={"location": places(make, [i])}, source="s", batch=i)
    write_tables(spark, base, {"file": make(file=[])["file"]}, dry_run=True)
    assert catalog.versions(spark, base) == [1, 2, 3]
    assert catalog.batch_written(spark, base, "s", 2) and not catalog.batch_written(spark, base, "s", 3) and not catalog.batch_written(spark, base, "t", 0)
    assert load_tables(spark, base)["location"].agg(F.sum("id")).first()[0] == 3
