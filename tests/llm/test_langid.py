import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from helpers import frame

from seqledger.llm.langid import ORDER, Scorer, fit, identify, keep_identified
from seqledger.llm.words import LOWER, chunks

TEXTS = {"aa": "the then they that this", "bb": "der dem das über öde", "cc": "lë què où ç'est les"}


def rows(n=240):
    rng = random.Random(4)
    out = []
    for i in range(n):
        lang = rng.choice(list(TEXTS))
        out.append((i, " ".join(rng.choice(TEXTS[lang].split()) for _ in range(rng.randint(4, 30))), lang))
    return out


def bits(texts, lang, text):
    """Code length by the definition, from counts of every context of one language."""
    after = {}
    for name, t in texts:
        if name == lang:
            b = bytes(ORDER) + bytes(LOWER[np.frombuffer(t.encode(), np.uint8)])
            for at in range(ORDER, len(b)):
                for k in range(ORDER + 1):
                    seen = after.setdefault((k, b[at - k : at]), {})
                    seen[b[at]] = seen.get(b[at], 0) + 1
    b, total = bytes(ORDER) + bytes(LOWER[np.frombuffer(text.encode(), np.uint8)]), 0.0
    for at in range(ORDER, len(b)):
        for k in range(ORDER, -1, -1):
            seen = after.get((k, b[at - k : at]))
            if not seen:
                continue
            whole = sum(seen.values()) + len(seen)
            if b[at] in seen:
                total -= np.log2(seen[b[at]] / whole)
                break
            total -= np.log2(len(seen) / whole)
        else:
            total += 8
    return total


def test_code_lengths_are_those_of_the_definition():
    texts = [(lang, t) for _, t, lang in rows(30)]
    model = fit(texts)
    ask = ["the öde", "x", "", "Über qzx 7 lë", texts[0][1]]
    scorer = Scorer(model)
    for _ in range(2):  # the second time from memory
        got = np.concatenate([scorer.lengths(d, o) for _, _, d, o in chunks(pa.array(ask), 9)])
        want = [[bits(texts, lang, t) for lang in model.langs] for t in ask]
        assert np.allclose(got, want)


def test_held_out_texts_are_told_apart(spark):
    data = rows()
    edge = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 :-)", "bb"), (None, "the then", "aa"), (1003, "the then", None), (1, "the then", "aa")]
    out = identify(frame(spark, data + edge)).collect()
    assert len(out) == len(data) + len(edge)
    by = {r["doc_id"]: r for r in out if r["doc_id"] not in (1, None)}
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in by)
    assert all(by[i]["lang_pred"] == lang for i, _, lang in data if i != 1)
    assert all(0 <= r["score"] <= 1 for r in out)
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "aa"]
    (alone,) = [r for r in out if r["doc_id"] is None]
    assert alone["held_out"] is False and alone["lang_pred"] == "aa"


def test_repeated_rows_and_long_texts_lose_no_language(spark):
    rng = random.Random(6)

    def text(lang, n):
        return " ".join(rng.choice(TEXTS[lang].split()) for _ in range(n))

    free = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1]
    copy = text("bb", 20)
    data = [(i, text("aa", 20), "aa") for i in free[:60]] + [(free[60], copy, "bb")] * 1000 + [(free[61], text("bb", 20), "bb")]
    out = identify(frame(spark, data)).filter(f"doc_id in ({free[60]}, {free[61]})").select("lang_pred").collect()
    assert len(out) == 1001 and {r[0] for r in out} == {"bb"}
    long = [(i, text("aa", 20), "aa") for i in free[:60]] + [(i, text("bb", 5000), "bb") for i in free[60:80]]
    assert all(len(t) > 20_000 for _, t, lang in long if lang == "bb")
    out = identify(frame(spark, long)).select("doc_id", "lang_pred").collect()
    assert dict(tuple(r) for r in out) == {i: lang for i, _, lang in long}


def test_memory_is_bounded_for_many_languages():
    rng = random.Random(9)
    texts = [(f"l{i:03}", "".join(rng.choice("abcdefgh ") for _ in range(300))) for i in range(200)]
    scorer = Scorer(fit(texts))
    assert scorer.bits.nbytes <= 8 << 20
    ask = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (9000, 3, 0, 5000)]
    few = [lang for lang in scorer.model.langs[:3]]
    alone = Scorer(fit([t for t in texts if t[0] in few]))
    got = np.concatenate([scorer.lengths(d, o) for _, _, d, o in chunks(pa.array(ask), 1 << 17)])
    want = np.concatenate([alone.lengths(d, o) for _, _, d, o in chunks(pa.array(ask), 1 << 17)])
    assert np.allclose(got[:, :3], want)


def test_nothing_to_learn_from(spark):
    assert [r["lang_pred"] for r in identify(frame(spark, [(1, "the", None)])).collect()] == ["und"]
    assert identify(frame(spark, [])).collect() == []


def test_rejected_documents_go(spark):
    docs = frame(spark, [*rows(), (2000, "...", "aa"), (2001, None, "aa")])
    kept = keep_identified(docs)
    assert kept.schema == docs.schema and sorted(r[0] for r in kept.collect()) == list(range(240))


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables here")
def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = identify(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").selectExpr("avg(cast(lang = lang_pred as int))")
    assert out.first()[0] > 0.97
