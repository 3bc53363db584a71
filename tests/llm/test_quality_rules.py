import random
import re

from helpers import frame, text_of, vocabulary

from seqledger.llm.quality_rules import judge, statistics

SPACE = "[^\x20\x09-\x0D]+"


def plain(text):
    text = text or ""
    w = re.findall(SPACE, text)
    at = {}
    for j in range(len(w) - 4):
        at.setdefault(tuple(w[j : j + 5]), []).append(j)
    again = {k for v in at.values() if len(v) > 1 for j in v for k in range(j, j + 5)}
    lines = [x for x in text.split("\n") if re.search(SPACE, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def rows():
    rng = random.Random(8)
    vocab = vocabulary(50)
    out = []
    for i in range(240):
        t = text_of(rng, vocab, rng.randint(12, 60))
        if i % 4 == 0:
            t = " ".join(x + rng.choice("#*$%") * 2 for x in t.split())
        out.append((i, t))
    few = vocabulary(3, 1)
    out += [(1000 + i, "\n".join(text_of(rng, few, rng.randint(0, 12)) for _ in range(6))) for i in range(30)]
    return [*out, (2000, None), (2001, ""), (2002, "\t\x0b\n"), (None, "a b c"), (3, out[3][1]), (2003, "ä € " * 30_000), (2004, "a a a a a a")]


def test_statistics_are_those_of_the_definitions(spark):
    data = rows()
    got = sorted((tuple(r) for r in statistics(frame(spark, data)).collect()), key=repr)
    assert got == sorted(((i, *plain(t)) for i, t in data), key=repr)


def test_rules_find_what_the_labels_mark(spark):
    data = rows()
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(240)] + [(None, 0, 0), (5, None, 1), (6, 7, 0)], "doc_id long, quality int, toxic int")
    out = judge(frame(spark, data), labels).collect()
    assert len(out) == len(data)
    by = {r["doc_id"]: r for r in out}
    for i, t in data[:240]:
        n, again = plain(t)[0], plain(t)[4]
        failed = n < 10 or 100 * again > 20 * n
        assert by[i]["base_failed"] == failed and by[i]["kept"] == (not failed and i % 4 > 0)
    assert by[2000]["base_failed"] and not by[2000]["kept"]


def test_without_labels_only_the_base_decides(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r["kept"] is not r["base_failed"] for r in judge(frame(spark, rows()), none).collect())
    assert judge(frame(spark, []), none).collect() == []


def test_plan_has_no_python(spark):
    none = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    plan = judge(frame(spark, rows()), none)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
