import hashlib
import random
import re

from helpers import LOWER, frame, text_of, vocabulary

from seqledger.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(docs, items, window=13):
    windows = {}
    for i, t in items:
        if i is None or t is None:
            continue
        w = WORD.findall(t.translate(LOWER))
        for j in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[j : j + window]), set()).add(str(i))
    out = []
    for i, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        hit, names = set(), set()
        for m in {len(x) for x in windows}:
            for j in range(len(w) - m + 1):
                if tuple(w[j : j + m]) in windows:
                    hit |= set(range(j, j + m))
                    names |= windows[tuple(w[j : j + m])]
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(names), sha, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def case():
    rng = random.Random(1)
    vocab = vocabulary(12)
    items = [(i, text_of(rng, vocab, rng.choice([1, 2, 5, 13, 14, 20, 40]))) for i in range(25)]
    items += [(3, items[4][1]), (None, "aa bb"), (77, None), (78, ""), (79, "?!"), (80, items[0][1])]
    docs = []
    for i in range(150):
        parts = [text_of(rng, vocab, rng.randint(0, 30))]
        if rng.random() < 0.7:
            w = rng.choice(items[:25])[1].split()
            at = rng.randrange(len(w))
            parts += [" ".join(w[at : at + rng.randint(1, 40)]).upper(), "zzz. " + text_of(rng, vocab, 9)]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(parts)))
    docs += [(None, docs[0][1]), (5, docs[6][1]), (900, None), (901, ""), (902, "…"), (903, "x " * 70_000)]
    return docs, items


def items_frame(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")


def test_report_is_that_of_all_windows(spark, monkeypatch):
    docs, items = case()
    want = plain(docs, items)
    found = sorted((tuple(r) for r in d.report(frame(spark, docs), items_frame(spark, items)).collect()), key=repr)
    assert found == want
    monkeypatch.setattr(d, "PART_CHARS", 300)  # several automata, one after the other
    found = sorted((tuple(r) for r in d.report(frame(spark, docs), items_frame(spark, items)).collect()), key=repr)
    assert found == want


def test_no_items_and_no_documents(spark):
    none = items_frame(spark, [])
    assert [r["n_hit"] for r in d.report(frame(spark, [(1, "a b")]), none).collect()] == [0]
    assert d.report(frame(spark, []), items_frame(spark, [(1, "a b")])).collect() == []


def test_contaminated_documents_go_or_lose_their_spans(spark):
    docs, items = case()
    table, tests = frame(spark, docs), items_frame(spark, items)
    bad = [i for i, *_, b in plain(docs, items) if b]
    kept = d.decontaminate(table, tests)
    assert kept.columns == table.columns and kept.schema == table.schema
    assert sorted(map(repr, [r[0] for r in kept.collect()])) == sorted(map(repr, [i for i, *_, b in plain(docs, items) if not b]))
    cut = d.decontaminate(table, tests, action="cut").collect()
    assert len(cut) == len(docs) and bad
    by = dict(docs[:150])
    for r in cut:
        if r["doc_id"] in bad and r["doc_id"] in by and r["doc_id"] != 5:
            assert len(r["text"]) < len(by[r["doc_id"]])
            w = WORD.findall(r["text"].translate(LOWER))
            n, hit = plain([(0, by[r["doc_id"]])], items)[0][1:3]
            assert len(w) == n - hit


def test_spans_are_places_in_the_text(spark):
    items = [(1, " ".join(f"w{i}" for i in range(20)))]
    text = "Éa, " + " ".join(f"W{i}" for i in range(3, 18)) + ". end"
    row = d.contamination(frame(spark, [(1, text)]), items_frame(spark, items)).first()
    (hit,) = row["hits"]
    assert text.encode()[hit["start"] : hit["end"]].decode() == " ".join(f"W{i}" for i in range(3, 18))
    assert (hit["word"], hit["end_word"], row["items"]) == (1, 16, ["1"])
