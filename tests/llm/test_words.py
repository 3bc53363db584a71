import numpy as np
import pyarrow as pa
from helpers import words
from hypothesis import given, settings
from hypothesis import strategies as st

from seqledger.llm.words import LOWER, NOT_SPACE, chain, chunks, shingle_sets, spans, word_hashes

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZé \t\n\x0b ß0", max_size=30)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(1, 20))
def test_spans_are_the_words_of_each_row(texts, size):
    got = []
    for _, _, data, offsets in chunks(pa.array(texts, pa.string()), size):
        data = LOWER[data]
        starts, ends, first = spans(data, offsets, NOT_SPACE)
        raw = data.tobytes()
        found = [raw[s:e].decode() for s, e in zip(starts, ends, strict=True)]
        got += [found[first[i] : first[i + 1]] for i in range(len(offsets) - 1)]
    assert got == [words(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(TEXT)
def test_shingle_sets_count_distinct_shingles(texts):
    got = {i: len(v) for i, v in shingle_sets(pa.array(texts, pa.string()), 3)}
    for i, t in enumerate(texts):
        w = words(t)
        want = {tuple(w[j : j + 3]) for j in range(len(w) - 2)} or ({tuple(w)} if w else set())
        assert got[i] == len(want)


def test_hashes_do_not_depend_on_the_place_and_differ_between_words():
    data = np.frombuffer(b"ab abc ab ba b " * 3, np.uint8)
    starts, ends, _ = spans(data, np.array([0, len(data)]), NOT_SPACE)
    h = word_hashes(data, starts, ends)
    assert h[0] == h[2] == h[5] and len(set(h.tolist())) == 4


def test_long_words_and_long_texts():
    text = "x" * 3_000_000 + " y " + "z " * 10
    (_, values), = shingle_sets(pa.array([text]), 4)
    assert len(values) == 3  # x y z z, y z z z and z z z z


def test_slices_of_a_batch_are_read_at_their_place():
    column = pa.array(["a b", "c d e", None, "f"]).slice(1)
    assert [len(v) for _, v in shingle_sets(column, 2)] == [2, 0, 1]


def test_chain_of_too_few_words_is_empty():
    assert len(chain(np.zeros(2, np.uint64), 3)) == 0
