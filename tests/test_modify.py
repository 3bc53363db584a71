"""Edits and cascades against a one-by-one simulation."""

import random

import pytest
from conftest import rows_of

from seqledger.operators import modify as m


def tables(make, rng):
    specimen = [{"id": i, "name": f"p{i}", "deleted": rng.random() < 0.2} for i in range(4)]
    sample = [{"id": i, "name": f"s{i}", "specimen_id": rng.randrange(4), "deleted": rng.random() < 0.3} for i in range(10)]
    readset = [{"id": i, "name": f"r{i}", "sample_id": rng.randrange(10), "deleted": rng.random() < 0.3} for i in range(30)]
    return make(specimen=specimen, sample=sample, readset=readset), specimen, sample, readset


def simulate_up(specimen, sample, readset, entries):
    """Ids one after the other, each seeing the flags the earlier ones left."""
    for table, ids in entries:
        rows = {"specimen": specimen, "sample": sample, "readset": readset}[table]
        for i in sorted(ids):
            if rows[i]["deleted"]:
                continue
            rows[i]["deleted"] = True
            s = None
            if table == "readset":
                s = sample[rows[i]["sample_id"]]
                if not (s["deleted"] or specimen[s["specimen_id"]]["deleted"]):
                    continue
                s["deleted"] = True
            elif table == "sample":
                s = rows[i]
            if s is not None:
                specimen[s["specimen_id"]]["deleted"] = True


@pytest.mark.parametrize("seed", range(6))
def test_delete_cascade_up(spark, make, seed):
    rng = random.Random(seed)
    t, specimen, sample, readset = tables(make, rng)
    entries = [("readset", rng.sample(range(30), 8)), ("sample", rng.sample(range(10), 2)), ("readset", rng.sample(range(30), 8)),
               ("readset", rng.sample(range(30), 5))]
    request = m.request_frame(spark, [{"table": n, "id": i} for n, i in entries])
    out = m.delete(t, request, "cascade_up")
    simulate_up(specimen, sample, readset, entries)
    for name, want in (("specimen", specimen), ("sample", sample), ("readset", readset)):
        got = out.changed.get(name, t[name])
        assert rows_of(got, "id", "deleted") == sorted(((r["id"], r["deleted"]) for r in want), key=repr), name


def test_readset_does_not_take_a_sample_whose_specimen_lives(spark, make):
    t = make(specimen=[{"id": 1}], sample=[{"id": 1, "specimen_id": 1}], readset=[{"id": 1, "sample_id": 1}])
    out = m.delete(t, m.request_frame(spark, [{"table": "readset", "id": [1]}]), "cascade_up")
    assert rows_of(out.report, "entity", "entity_id") == [("readset", 1)]
    # A sample, in contrast, takes its specimen with it, whatever else the specimen holds.
    out = m.delete(t, m.request_frame(spark, [{"table": "sample", "id": [1]}]), "cascade_up")
    assert rows_of(out.report, "entity", "entity_id") == [("sample", 1), ("specimen", 1)]


def test_cascade_down_stops_at_rows_with_live_children(spark, make):
    t = make(
        specimen=[{"id": 1}], sample=[{"id": 1, "specimen_id": 1}, {"id": 2, "specimen_id": 1}],
        readset=[{"id": 1, "sample_id": 1}, {"id": 2, "sample_id": 2, "deleted": True}],
    )
    out = m.delete(t, m.request_frame(spark, [{"table": "specimen", "id": [1]}]), "cascade_down")
    assert rows_of(out.report, "entity", "entity_id") == [("sample", 2), ("specimen", 1)]


def test_delete_then_undelete_restores(spark, make):
    t = make(specimen=[{"id": 1}], sample=[{"id": 1, "specimen_id": 1}], readset=[{"id": 1, "sample_id": 1}])
    ask = m.request_frame(spark, [{"table": "sample", "id": [1]}])
    gone = {**t, **m.delete(t, ask, "cascade").changed}
    assert rows_of(gone["specimen"], "deleted") == [(True,)] and rows_of(gone["readset"], "deleted") == [(True,)]
    back = {**gone, **m.undelete(gone, ask, "cascade").changed}
    for name in ("specimen", "sample", "readset"):
        assert rows_of(back[name], "deleted") == [(False,)]


def test_edit_refuses_and_skips(spark, make):
    t = make(sample=[{"id": 1, "name": "a", "tumour": True}, {"id": 2, "name": "b", "tumour": False}])
    ask = m.request_frame(spark, [
        {"table": "sample", "id": [1, 2], "column": "tumour", "new": "true"},
        {"table": "sample", "id": [2], "column": "name", "new": None},
    ])
    out = m.apply(t, "edit", ask)
    assert rows_of(out.changed["sample"], "id", "name", "tumour") == [(1, "a", True), (2, None, True)]
    assert rows_of(out.warnings, "entity_id") == [(1,)]
    assert m.apply(t, "edit", ask, dry_run=True).changed == {}
    with pytest.raises(ValueError):
        m.apply(t, "edit", m.request_frame(spark, [{"table": "sample", "id": [1], "column": "name", "new": "b"}]))
    with pytest.raises(LookupError):
        m.apply(t, "delete", m.request_frame(spark, [{"table": "sample", "id": [9]}]))


def test_two_word_tables_can_be_changed(spark, make):
    t = make(operation_config=[{"id": 1, "name": "c"}])
    out = m.apply(t, "delete", m.request_frame(spark, [{"table": "operation_config", "id": [1]}]))
    assert rows_of(out.changed["operation_config"], "deleted") == [(True,)]


def test_curate_takes_everything_below(spark, make):
    t = make(
        specimen=[{"id": 1}, {"id": 2}], sample=[{"id": 1, "specimen_id": 1}, {"id": 2, "specimen_id": 2}],
        readset=[{"id": 1, "sample_id": 1}, {"id": 2, "sample_id": 2}], file=[{"id": 1, "name": "f"}],
        readset_file=[{"readset_id": 1, "file_id": 1}, {"readset_id": 2, "file_id": 1}],
    )
    out = m.curate(t, m.request_frame(spark, [{"table": "sample", "id": [1]}]), "cascade_up")
    assert rows_of(out.changed["specimen"], "id") == [(2,)]
    assert rows_of(out.changed["readset"], "id") == [(2,)]
    assert rows_of(out.changed["readset_file"], "readset_id", "file_id") == [(2, 1)]


def test_only_one_cascade_switch():
    assert m.cascade_mode(cascade_down=True) == "cascade_down"
    with pytest.raises(ValueError):
        m.cascade_mode(cascade=True, cascade_up=True)


def test_a_request_with_empty_entries_a_stamp_and_domains(spark, make):
    t = make(file=[{"id": i, "name": f"f{i}", "state": "VALID"} for i in range(3)])
    ask = spark.createDataFrame([("file", 0, "state", "ON_HOLD", 0), ("file", None, "state", "INVALID", 1), ("file", 1, "state", "VALID", 2)], m.REQUEST)
    out = m.apply(t, "edit", ask, as_of="2024-05-05 00:00:00")
    assert rows_of(out.warnings, "action", "entity_id", "detail") == [("no_ids", None, "entry 1"), ("unchanged", 1, "state: VALID -> VALID")]
    rows = out.changed["file"].select("id", "state", out.changed["file"]["modification"].cast("string").alias("at"))
    assert rows_of(rows, "id", "state", "at") == [(0, "ON_HOLD", "2024-05-05 00:00:00"), (1, "VALID", None), (2, "VALID", None)]
    only_empty = m.apply(t, "delete", ask.filter("id IS NULL"))
    assert not only_empty.changed and rows_of(only_empty.warnings, "action") == [("no_ids",)]
    with pytest.raises(ValueError, match="nonsense"):
        m.apply(t, "edit", ask.replace("ON_HOLD", "nonsense"))
