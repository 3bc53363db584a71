from conftest import rows_of

from seqledger.operators import cleanup as c


def world(make):
    return make(
        operation=[
            {"id": 1, "name": "transfer", "platform": "a"}, {"id": 2, "name": "transfer", "platform": "a"},
            {"id": 3, "name": "other"}, {"id": 4, "name": "other"},
        ],
        job=[
            {"id": 1, "operation_id": 1, "name": "j"}, {"id": 2, "operation_id": 2, "name": "j"},
            {"id": 3, "operation_id": 3, "name": "k"}, {"id": 4, "operation_id": 3, "name": "lonely"},
        ],
        metric=[
            {"id": 1, "job_id": 1, "name": "m", "value": "1"}, {"id": 2, "job_id": 2, "name": "m", "value": "1"},
            {"id": 3, "job_id": 4, "name": "m", "value": "1"}, {"id": 4, "job_id": 4, "name": "n", "value": None},
        ],
        file=[
            {"id": 1, "name": "a.bam", "deliverable": False}, {"id": 2, "name": "a.bam", "deliverable": True},
            {"id": 3, "name": "b.bam"}, {"id": 4, "name": "c.bam", "md5sum": "x"}, {"id": 5, "name": "a.bam", "md5sum": "y"},
        ],
        location=[{"id": 1, "file_id": 2, "uri": "h:///a.bam", "endpoint": "h"}, {"id": 2, "file_id": 4, "uri": "h:///c.bam", "endpoint": "h"}],
        readset=[{"id": 1}, {"id": 2}],
        readset_operation=[{"readset_id": 1, "operation_id": 1}, {"readset_id": 1, "operation_id": 2}, {"readset_id": 2, "operation_id": 2}],
        readset_job=[{"readset_id": 1, "job_id": 1}, {"readset_id": 2, "job_id": 2}],
        readset_metric=[{"readset_id": 1, "metric_id": 1}, {"readset_id": 2, "metric_id": 2}, {"readset_id": 1, "metric_id": 4}],
        readset_file=[{"readset_id": 1, "file_id": 1}, {"readset_id": 2, "file_id": 2}],
        job_file=[{"job_id": 1, "file_id": 1}, {"job_id": 1, "file_id": 2}, {"job_id": 3, "file_id": 3}],
    )


def test_whole_cleanup_is_idempotent_and_keeps_links_valid(make):
    once, report = c.cleanup_all(world(make))
    # The unlocated twin is rescued, the job-only file dropped, duplicates merged.
    assert rows_of(once["file"], "id") == [(2,), (4,), (5,)]
    assert rows_of(once["readset_file"], "readset_id", "file_id") == [(1, 2), (2, 2)]
    assert rows_of(once["operation"], "id") == [(1,), (3,)]
    assert rows_of(once["readset_operation"], "readset_id", "operation_id") == [(1, 1), (2, 1)]
    assert rows_of(once["job"], "id") == [(1,), (4,)]
    assert rows_of(once["metric"], "id", "job_id") == [(1, 1), (4, 4)]
    assert rows_of(once["readset_metric"], "readset_id", "metric_id") == [(1, 1), (1, 4), (2, 1)]
    assert report.count() > 0
    twice, again = c.cleanup_all(once)
    for name in ("file", "operation", "job", "metric", "readset_file", "job_file", "readset_metric"):
        assert rows_of(twice[name], *twice[name].columns) == rows_of(once[name], *once[name].columns), name
    assert again.filter("rows_deleted > 0 or rows_remapped > 0").count() == 0


def test_duplicate_files_group_null_md5_and_prefer_deliverable(make):
    t = world(make)
    assert rows_of(c.duplicate_files(t), "name", "md5sum", "keep_file_id", "cnt") == [("a.bam", None, 2, 2)]
    out = c.deduplicate_files(t)
    assert rows_of(out["job_file"], "job_id", "file_id") == [(1, 2), (3, 3)]


def test_null_values_form_groups_but_never_match(make):
    t = make(
        metric=[{"id": 1, "job_id": 1, "name": "m", "value": None}, {"id": 2, "job_id": 1, "name": "m", "value": None}],
        readset_metric=[{"readset_id": 1, "metric_id": 1}, {"readset_id": 1, "metric_id": 2}],
    )
    assert rows_of(c.duplicate_metrics(t), "keep_metric_id", "cnt") == [(1, 2)]
    assert c.prune_metric_links(t).count() == 2


def test_null_config_data_merges_into_one(make):
    t = make(operation_config=[{"id": 3}, {"id": 1}, {"id": 2, "data": bytearray(b"x")}], operation=[{"id": 1, "operation_config_id": 3}])
    assert rows_of(c.config_mapping(t), "old_id", "new_id") == [(1, 1), (2, 2), (3, 1)]
    assert rows_of(c.consolidate_configs(t)["operation"], "operation_config_id") == [(1,)]


def test_topup_tie_goes_to_lowest_id_and_all_names_become_aliases(make):
    t = make(sample=[
        {"id": 5, "name": "S-1RT"}, {"id": 2, "name": "S-01RT"}, {"id": 3, "name": "S-2RT"}, {"id": 4, "name": "S-3RT", "alias": ["z"]},
        {"id": 6, "name": "S-2DT"},
    ], readset=[{"id": 1, "sample_id": 4}])
    pairs = c.topup_pairs(t["sample"])
    assert rows_of(pairs, "id_keep", "id_remove") == [(2, 3), (2, 4)]
    out = c.merge_topups(t, pairs)
    assert rows_of(out["sample"], "id", "alias") == [(2, ["S-2RT", "S-3RT"]), (5, None), (6, None)]
    assert rows_of(out["readset"], "sample_id") == [(2,)]


def test_uri_suffix_is_taken_literally(make):
    t = make(
        operation=[{"id": 1}], job=[{"id": 1, "operation_id": 1}, {"id": 2, "operation_id": 1}],
        file=[{"id": 1, "name": "a_b"}, {"id": 2, "name": "a_b"}, {"id": 3, "name": "a_b"}],
        location=[{"id": 1, "file_id": 2, "uri": "h:///aXb", "endpoint": "h"}, {"id": 2, "file_id": 3, "uri": "h:///a_b", "endpoint": "h"}],
        job_file=[{"job_id": 1, "file_id": 1}, {"job_id": 2, "file_id": 2}, {"job_id": 2, "file_id": 3}],
        readset_file=[{"readset_id": 1, "file_id": 1}],
    )
    assert rows_of(c.rescue_candidates(t), "remove_file_id", "located_file_id") == [(1, 3)]


def test_relink_copies_once_per_other_metric(make):
    t = make(
        job=[{"id": 1}], readset_job=[{"readset_id": 1, "job_id": 1}],
        metric=[{"id": i, "name": "m", "value": "1" if i < 3 else str(i)} for i in range(1, 6)],
        readset_metric=[{"readset_id": 1, "metric_id": i} for i in range(1, 6)],
    )
    # After pruning, metrics 3, 4 and 5 are held beside the kept one.
    assert rows_of(c.relink_jobs_to_kept(t), "keep_metric_id", "job_id", "value") == [(1, 1, "1")] * 3
