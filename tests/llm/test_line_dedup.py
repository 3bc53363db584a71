import random

from helpers import LOWER, frame, text_of, vocabulary

from seqledger.llm.line_dedup import remove_repeats, report


def plain(rows, least=8):
    """Result of every row: units in rank order, the first of a normal form stays."""
    ranked = sorted({(i is not None, i, t) for i, t in rows if t}, key=lambda x: (x[0], x[1] or 0))
    assert len({(i, t) for _, i, t in ranked}) == len({i for _, i, _ in ranked})
    seen, gone, met = {}, {}, {}
    for _, i, t in ranked:
        for at, line in enumerate(t.split("\n")):
            key = " ".join(line.translate(LOWER).split())
            if len(key.split()) >= least:
                met.setdefault(key, set()).add((i, t, at))
            if len(key.split()) >= least and seen.setdefault(key, (i, t, at)) != (i, t, at):
                gone.setdefault((i, t), set()).add(at)
    out = []
    for i, t in rows:
        lines, drop = (t.split("\n") if t else []), gone.get((i, t), set())
        text = t if not t else "\n".join(x for k, x in enumerate(lines) if k not in drop)
        start, spans = 0, []
        for k, x in enumerate(lines):
            if k in drop:
                spans.append(f"{start}-{start + len(x)}")
            start += len(x) + 1
        repeated = run = longest = 0
        for k, x in enumerate(lines):
            words = x.translate(LOWER).split()
            if len(met.get(" ".join(words), ())) > 1:
                repeated, run = repeated + 1, run + len(words)
            elif words:
                run = 0
            longest = max(longest, run)
        out.append((i, text, len(lines), len(drop), sum(len(lines[k]) for k in drop), ",".join(spans), repeated, longest))
    return sorted(out, key=repr)


def case():
    rng = random.Random(2)
    vocab = vocabulary(40)
    lines = [text_of(rng, vocab, rng.choice([2, 7, 8, 9, 60])) for _ in range(12)]
    rows = []
    for i in range(80):
        mine = [rng.choice([rng.choice(lines), rng.choice(lines).upper(), "  " + rng.choice(lines).replace(" ", " \t"), text_of(rng, vocab, 12), ""])
                for _ in range(rng.randint(1, 9))]
        rows.append((i, "\n".join(mine)))
    rows += [rows[3], rows[3], (200, rows[5][1]), (None, rows[6][1]), (201, None), (202, ""), (203, "\n\n"), (204, "\n".join(lines * 500))]
    return rows


def test_report_is_that_of_one_pass_in_rank_order(spark):
    rows = case()
    assert sorted((tuple(r) for r in report(frame(spark, rows)).collect()), key=repr) == plain(rows)


def test_other_columns_stay_and_clashing_names_are_lengthened(spark):
    docs = frame(spark, case()).withColumnRenamed("a", "removed").withColumnRenamed("n", "_key")
    out = remove_repeats(docs)
    assert out.columns == [*docs.columns, "n_units", "removed_"]
    assert out.count() == docs.count() and {r["removed"] for r in out.collect()} == {1}


def test_removed_places_are_in_the_original(spark):
    line = "one two three four five six seven eight nine"
    rows = [(1, line), (2, "éb\n" + line.upper() + "\ncd")]
    out = {r["doc_id"]: r for r in remove_repeats(frame(spark, rows)).collect()}
    (place,) = out[2]["removed"]
    assert out[2]["text"] == "éb\ncd" and not out[1]["removed"]
    assert rows[1][1][place["start"] : place["end"]].lower() == line


def test_paragraphs_and_empty_table(spark):
    p = "a b c d\ne f g h"
    out = remove_repeats(frame(spark, [(1, p), (2, "x\n\n" + p)]), separator="\n\n").orderBy("doc_id").collect()
    assert [r["text"] for r in out] == [p, "x"]
    assert remove_repeats(frame(spark, [])).collect() == []
