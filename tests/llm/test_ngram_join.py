import random

import pytest
from helpers import frame, text_of, vocabulary, words
from pyspark.sql import functions as F

from seqledger.llm import ngram_join
from seqledger.llm.components import components
from seqledger.llm.ngram_join import keep_one_of_each, ngram_groups, prefix_length


def plain(rows, k, percent):
    sets = []
    for i, t, *_ in rows:
        w = words(t)
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())))
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, p), (j, q) = sets[a], sets[b]
            if i is not None and j is not None and p and q and 100 * len(p & q) >= percent * len(p | q):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=repr)


def got(docs, **kw):
    return sorted((tuple(r) for r in ngram_groups(docs, **kw).collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocab = vocabulary(60)
    out, shared = [], text_of(rng, vocab, 30)
    for _ in range(60):
        base = text_of(rng, vocab, rng.choice([1, 3, 5, 12, 40, 120]))
        out.append(base)
        for _ in range(rng.randint(0, 3)):
            w = base.split()
            for _ in range(rng.randint(0, max(1, len(w) // 18))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(" ".join(w).upper() if rng.random() < 0.3 else " ".join(w))
    out += [shared + " " + text_of(rng, vocab, 10) for _ in range(20)]
    rng.shuffle(out)
    rows = [(i * 3 + 1, t) for i, t in enumerate(out)]
    return [*rows, (None, out[0]), (None, None), (2, None), (5, ""), (8, " \t\n"), (rows[0][0], out[0]), (rows[1][0], out[1]), (0, "é" * 50)]


def test_groups_are_those_of_all_pairs(spark, rows):
    assert got(frame(spark, rows)) == plain(rows, 4, 85)


def test_split_tiles_and_joined_ids_give_the_same(spark, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 2)
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    monkeypatch.setattr(ngram_join, "SEEN", 1)
    assert got(frame(spark, rows), k=2, percent=60) == plain(rows, 2, 60)


def test_large_group_of_near_copies_and_exact_copies(spark):
    rng = random.Random(5)
    vocab = vocabulary(3000)
    base = text_of(rng, vocab, 200).split()
    rows = []
    for i in range(120):
        w = list(base)
        w[rng.randrange(200)] = "other"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base)) for i in range(100)]
    out = got(frame(spark, rows))
    assert {c for _, _, c in out} == {0}


def test_empty_table_and_table_without_sets(spark):
    assert got(frame(spark, [])) == []
    assert got(frame(spark, [(4, None), (3, "")])) == [(3, 0, 3), (4, 0, 4)]


def test_prefix_is_long_enough():
    for n in range(1, 300):
        for percent in (60, 80, 85, 100):
            least = -(-percent * n // 100)
            assert prefix_length(n, percent) == n - least + 1 >= 1


def test_one_document_of_each_group_stays(spark, rows):
    docs = frame(spark, rows)
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    want = {c for _, _, c in plain(rows, 5, 80)} - {None}
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 2


def test_texts_of_one_id_are_documents_of_their_own(spark):
    rng = random.Random(8)
    vocab = vocabulary(900)
    a, b, c = (text_of(rng, vocab, 40) for _ in range(3))
    near = c.rsplit(" ", 1)[0] + " other"
    rows = [(1, a), (1, b), (1, b), (2, a), (3, c), (3, near), (4, None), (4, None), (None, a)]
    docs = frame(spark, rows).withColumns({"node": F.lit("x"), "i": F.lit(1), "low": F.lit(2)})
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    first = [t for i, t in got if i == 3]
    assert len(first) == 1 and first[0] in (c, near)
    # Of the two places of text a, that under the lesser name stays: 1 where a goes by the id, else 2.
    assert sorted((t for i, t in got if i in (1, 2)), key=repr) == sorted((a, b)) and (1, b) in got
    assert [i for i, _ in got if i in (4, None)] == [4, None]


def test_pairs_are_left_to_the_first_tile_only(spark, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "BEFORE", 1)
    assert got(frame(spark, rows), k=2, percent=50) == plain(rows, 2, 50)
    monkeypatch.setattr(ngram_join, "BEFORE", 7)
    assert got(frame(spark, rows), k=2, percent=50) == plain(rows, 2, 50)


def test_components_of_a_path_a_star_and_loose_ends(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (None, 3), (40, 100)]
    found = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {i: 10 for i in [*range(10, 41), *range(100, 150)]}
