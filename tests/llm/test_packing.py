import random

import pytest
from helpers import frame, words
from hypothesis import given, settings
from hypothesis import strategies as st

from seqledger.llm.packing import pack, pack_documents


def best_cost(sizes, lengths, overhead):
    """Least cost of all ways to share out a few sizes."""
    best = [float("inf")]

    def place(i, bins):
        if i == len(sizes):
            best[0] = min(best[0], sum(min(c for c in lengths if c >= b) + overhead for b in bins))
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= max(lengths):
                place(i + 1, bins[:k] + [bins[k] + sizes[i]] + bins[k + 1 :])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 16), min_size=1, max_size=7), st.sampled_from([(16,), (4, 8, 16), (5, 16), (7, 9, 16)]), st.integers(0, 3))
def test_bins_hold_their_sizes_and_cost_little_more_than_the_best(sizes, lengths, overhead):
    sizes = sorted(sizes, reverse=True)
    where, caps = pack(sizes, lengths, overhead)
    fill = [0] * len(caps)
    for size, b in zip(sizes, where, strict=True):
        fill[b] += size
    assert all(f > 0 and c == min(x for x in lengths if x >= f) for f, c in zip(fill, caps, strict=True))
    cost = sum(caps) + overhead * len(caps)
    assert cost <= 1.5 * best_cost(sizes, lengths, overhead) + max(lengths)


def test_best_fit_takes_the_tightest_bin():
    where, caps = pack([9, 8, 2, 1], (10,), 0)
    assert where == [0, 1, 1, 0] and caps == [10, 10]


def test_one_short_text_gets_the_least_length():
    assert pack([3], (4, 8, 16), 1) == ([0], [4])


def test_pieces_cover_every_text_once(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 3, 15, 16, 17, 40])))) for i in range(120)]
    rows += [(5, "a b"), (5, "a b"), (None, "x y z"), (None, "x y z"), (300, None), (301, " \n"), (302, "v " * 5000)]
    out = pack_documents(frame(spark, rows), lengths=(4, 8, 16), overhead=1, shard_words=500).collect()
    bins = {}
    for r in out:
        bins.setdefault(r["bin_id"], []).append(r)
    for pieces in bins.values():
        pieces.sort(key=lambda r: r["bin_offset"])
        at = 0
        for p in pieces:
            assert p["bin_offset"] == at
            at += p["length"]
        assert pieces[0]["capacity"] == min(c for c in (4, 8, 16) if c >= at)
    want = sorted((repr(i), s, min(16, len(words(t)) - s)) for i, t in rows for s in range(0, len(words(t)), 16))
    assert sorted((repr(r["doc_id"]), r["start"], r["length"]) for r in out) == want
    assert len({r["bin_id"] >> 32 for r in out}) > 3


def test_empty_table_and_wrong_lengths(spark):
    assert pack_documents(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        pack_documents(frame(spark, []), lengths=())
