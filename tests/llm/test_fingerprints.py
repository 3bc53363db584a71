import hashlib
import random
import re

import pytest
from helpers import frame, text_of, vocabulary
from pyspark.sql import functions as F

from seqledger.llm import fingerprints as f


def shingles(text, k=5):
    w = re.findall("[^\x20\x09-\x0D]+", text or "")
    return [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []


def plain_sketch(parts, below="4"):
    h = {hashlib.md5(s.encode()).hexdigest()[:16] for s in parts}
    low = {x for x in h if x < below}
    return sorted(low) if low else sorted(h)[:1]


def likeness(a, b):
    return 1.0 if not a and not b else len(set(a) & set(b)) / len(set(a) | set(b))


def plain(rows):
    """Rows of (doc_id, text) with distinct ids."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        a, e, b = (plain_sketch(shingles(t)) for t in (text, edited, after))
        out[doc] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), " ".join(a), " ".join(e), likeness(a, e), likeness(a, b),
                    len(set(a) & set(e)) / len(a) if a else 1.0, len(set(a) & set(b)) / len(a) if a else 1.0)
    return out


def result(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_plain_version(spark, seed):
    rng = random.Random(seed)
    vocab = vocabulary(200)
    rows = [(i * 3 - 40, text_of(rng, vocab, rng.choice([0, 1, 4, 5, 6, 30, 300]))) for i in range(60)]
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, rows[5][1]), (-(2**63), "least"), (2**63 - 1, "é\U0001F600 ü" * 30), (None, "no id"), (1004, "x" * 300_000)]
    assert result(f.fingerprints(frame(spark, rows))) == plain(rows)


def test_ranges_hand_over_their_first_row(spark, monkeypatch):
    monkeypatch.setattr(f, "RANGE_BYTES", 50)
    rows = [(i, f"text number {i} of the table") for i in range(97)]
    assert result(f.fingerprints(frame(spark, rows).repartition(5))) == plain(rows)


def test_one_row_follows_itself_and_no_rows_give_none(spark):
    assert result(f.fingerprints(frame(spark, [(7, "a b c d e f g h")]))) == plain([(7, "a b c d e f g h")])
    assert f.fingerprints(frame(spark, [])).collect() == []


def test_rows_of_one_id_follow_each_other(spark):
    rows = [(1, "one two three"), (1, "one two three"), (1, "four five six"), (0, "zero"), (2, "two")]
    out = sorted(tuple(r) for r in f.fingerprints(frame(spark, rows)).collect())
    again = sorted(tuple(r) for r in f.fingerprints(frame(spark, rows[::-1]).repartition(3)).collect())
    assert out == again and [r[0] for r in out] == [0, 1, 1, 1, 2]


def test_sketches_merge_and_estimate_containment(spark):
    rng = random.Random(5)
    vocab = vocabulary(500)
    whole = text_of(rng, vocab, 4000)
    part = " ".join(whole.split(" ")[:400])
    row = spark.createDataFrame([(whole, part, text_of(rng, vocab, 3), text_of(rng, vocab, 4))], "w string, p string, a string, b string").select(
        f.containment(f.sketch(F.col("p")), f.sketch(F.col("w"))).alias("held"), f.likeness(f.sketch(F.col("p")), f.sketch(F.col("w"))).alias("like"),
        *[f.merge(f.sketch(F.col(x)), f.sketch(F.col(y))).alias(x + y) for x, y in ("wp", "ab", "pa")], "a", "b", "p").first()
    assert row["held"] == 1.0 and 0.05 < row["like"] < 0.15
    assert row["ab"] == plain_sketch(shingles(row["a"]) + shingles(row["b"])) and row["pa"] == plain_sketch(shingles(row["p"]) + shingles(row["a"]))
