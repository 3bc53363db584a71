import random
from pathlib import Path

import pytest
from helpers import words

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


def test_stages_are_in_order_and_keep_the_columns(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")
def test_every_stage_against_its_plain_version(spark):
    from test_decontaminate import plain as contaminated
    from test_line_dedup import plain as lines
    from test_ngram_join import plain as groups

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    columns, rows = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), docs.schema)
        assert docs.columns == columns, name
        got = {r["doc_id"]: r["text"] for r in docs.collect()}
        data = sorted(rows.items())
        if name == "language_id":
            want = rows  # all of them have letters of a learned language
        elif name == "ngram_jaccard_join":
            want = {i: rows[i] for i in {c for _, _, c in groups(data, 5, 80)}}
        elif name == "substring_dedup":
            want = {r[0]: r[1] for r in lines(data)}
        else:
            want = {i: rows[i] for i, *_, bad in contaminated(data, items) if not bad}
        assert got == want, name
        rows = got
    packed = corpus_pipeline.best_fit_packing(spark, docs, FOLDER).collect()
    total = {}
    for r in packed:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == {i: len(words(t)) for i, t in rows.items() if words(t)}


def test_run_over_edge_cases(spark, tmp_path):
    rng = random.Random(0)
    text = lambda lang: " ".join(rng.choice({"aa": "the then they this", "bb": "der dem das öde"}[lang].split()) for _ in range(40))
    rows = [(i, text(lang), lang, "s", 1) for i, lang in enumerate(["aa", "bb"] * 30)]
    rows += [(100, None, "aa", None, None), (101, "", None, None, None), (102, "12 34", "aa", "s", 2), (None, text("aa"), "aa", "s", 3), rows[4], rows[4]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, rows[7][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in out}
    assert ids == {*range(60), None} - {7} and len([r for r in out if r["doc_id"] == 4]) == 1
