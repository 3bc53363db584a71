import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import LOWER, vocabulary

from seqledger.llm import divergence as d

SCHEMA = "doc_id long, text string, lang string, source string, term string, v long, block int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, a, s, "x", 1, 2) for i, (t, a, s) in enumerate(rows)], SCHEMA)


def terms(text):
    return re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(rows, least=3, top=200):
    held, groups = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = terms(text)
        held[lang or ""].update(set(words))
        groups[lang or "", source or ""].update(words)
    kept = {a: {t for t, n in c.items() if n >= least} for a, c in held.items()}
    out = []

    def p(counts, lang):
        size = sum(counts[t] for t in kept[lang]) + len(kept[lang])
        return {t: 1 + 10**9 * (counts[t] + 1) // size for t in kept[lang]}

    share = {g: p(c, g[0]) for g, c in groups.items()}
    for lang in kept:
        whole = Counter()
        for g, c in groups.items():
            if g[0] == lang:
                whole.update(c)
        q = p(whole, lang)
        for g in (g for g in groups if g[0] == lang):
            pairs = [(-sum((share[g][t] - share[h][t]) ** 2 // share[h][t] for t in kept[lang]), h[1]) for h in groups if h[0] == lang and h != g]
            named = [(-((share[g][t] - q[t]) ** 2 // q[t]), t) for t in kept[lang] if groups[g][t] and share[g][t] > q[t]]
            for part, found in (("pair", pairs), ("term", named)):
                ranked = sorted(found, key=lambda x: (x[0], x[1].encode()))
                out += [(*g, part, item, -value, i + 1) for i, (value, item) in enumerate(ranked) if part == "pair" or i < top]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocab = [*vocabulary(60, seed), "a", "Ab", "abcabcabc", "abcabcabd", "ab" * 40, "é" * 9, "x" * 200, "Ünder"]
    return [(rng.choice([" ", "1", ", "]).join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 8, 40]))),
             rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None, "é"])) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_plain_version(spark, seed):
    rows = corpus(seed) + [(None, "xx", "s1"), ("", "xx", "s2"), ("only once here", "yy", None), ("123 456", "en", "s9")]
    assert result(d.divergence(frame(spark, rows))) == plain(rows)


def test_few_cells_small_slices_and_tiles_change_nothing(spark, monkeypatch):
    rows = corpus(7)
    for name, value in (("CELLS", 64), ("SLICE_TERMS", 10), ("SLICE_BYTES", 50), ("BLOCKS", 3), ("WAITING", 5), ("BLOCK_TERMS", 4), ("TILE_SOURCES", 2)):
        monkeypatch.setattr(d, name, value)
    # Workers import the module anew, so the limits that count are those of the plan and of the helpers below.
    assert result(d.divergence(frame(spark, rows), top=5)) == plain(rows, top=5)


def test_sums_of_a_stream_do_not_depend_on_when_they_are_taken(monkeypatch):
    rng = random.Random(3)
    rows, want = [], Counter()
    for _ in range(30):
        names = sorted({rng.choice([b"a", b"bb", b"c", b"dd"]) for _ in range(3)})
        sources = ["s", "t"][: rng.randint(1, 2)]
        for _ in range(2):
            t, s, n = rng.randrange(len(names)), rng.randrange(len(sources)), rng.randint(1, 5)
            want[names[t], sources[s]] += n
            columns = [np.array([x], k).tobytes() for x, k in ((t, np.int32), (s, np.int32), (n, np.int64), (1, np.int64))]
            rows.append((b"".join(x + b"\0" for x in names), sources, *columns))
    for waiting in (0, 3, 1000):
        monkeypatch.setattr(d, "WAITING", waiting)
        held = d._Sum()
        for x in rows:
            held.add(*x)
        names, sources, t, s, n, docs = held.total()
        assert {(names[a][:-1], sources[b]): c for a, b, c in zip(t, s, n.tolist(), strict=True)} == dict(want) and docs.sum() == 60


def test_scaled_shares_are_exact():
    for n, size in ((0, 1), (3, 7), (10**12, 10**12 + 5), (9 * 10**14, 9 * 10**15)):
        assert int(d.scaled(np.array([n]), size)[0]) == 1 + 10**9 * (n + 1) // size


def test_empty_and_term_less_tables(spark):
    assert result(d.divergence(frame(spark, []))) == []
    rows = [("1 2 3", "en", "a"), (None, "en", "b"), ("one", None, None)]
    assert result(d.divergence(frame(spark, rows))) == plain(rows) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
