import random
from functools import cache

import pytest
from helpers import frame
from tokenizers import Tokenizer, models, normalizers

from seqledger.llm.token_counts import SPACE, Counter, count_tokens, read_vocabulary

PIECES = [("a", -1.0), ("b", -2.0), ("ab", -3.0), ("ba", -3.0), ("aba", -4.0), (SPACE, -1.5), (SPACE + "a", -2.0), ("bb", -4.0), ("é", -9.0)]


def plain(text):
    """Every way to cut a short text; unknown characters stand alone. Best score only."""
    scores = dict(PIECES)

    @cache
    def best(at):
        if at == len(text):
            return 0.0
        ways = [scores[text[at:e]] + best(e) for e in range(at + 1, len(text) + 1) if text[at:e] in scores]
        if text[at] not in scores:
            ways.append(-19.0 + best(at + 1))
        return max(ways)

    return best(0)


def tokenizer(vocab, fallback):
    t = Tokenizer(models.Unigram(vocab, 0, fallback))
    t.normalizer = normalizers.Sequence([normalizers.Prepend(SPACE), normalizers.Replace(" ", SPACE)])
    return t


def test_scores_are_the_best_of_all_cuts_and_ties_those_of_the_tokenizer():
    rng = random.Random(1)
    for fallback in (False, True):
        other = [("<unk>", 0.0)] + ([(f"<0x{i:02X}>", 0.0) for i in range(256)] if fallback else [])
        counter, real = Counter(PIECES, other), tokenizer([other[0], *PIECES, *other[1:]], fallback)
        for _ in range(400):
            text = "".join(rng.choice("aabb é x" if fallback else "aabb é") for _ in range(rng.randint(0, 14)))
            n, score = counter.count(text)
            assert n == len(real.encode(text, add_special_tokens=False).ids), text
            if text:
                assert score == plain(SPACE + text.replace(" ", SPACE))


def test_unknown_runs_are_one_piece_without_bytes():
    assert Counter(PIECES, [("<unk>", 0.0)]).best("axxxb")[0] == 3
    assert Counter([], []).best("xy")[0] == 1


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def test_counts_of_a_real_vocabulary(spark, vocabulary):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    real = tokenizer([(model.id_to_piece(i), model.get_score(i)) for i in range(model.vocab_size())], True)
    texts = ["Hello world", "  two  spaces\n\ttab", "日本語 😀 text", "", "x" * 5000, "naïve café 123 </s> <0x0A>", "▁ ▁▁ a", "the " * 30_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a"), (0, "a"), (50, None)]
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_chars"]) for r in count_tokens(frame(spark, rows), vocabulary).collect()), key=repr)
    assert got == sorted(((i, len(real.encode(t or "", add_special_tokens=False).ids), len(t or "")) for i, t in rows), key=repr)


def test_memory_is_bounded_and_changes_nothing(monkeypatch, vocabulary):
    from seqledger.llm import token_counts

    words, other = read_vocabulary(vocabulary)
    want = Counter(words, other).count("some words and some more words")
    monkeypatch.setattr(token_counts, "MEMORY", 2)
    small = Counter(words, other)
    assert small.count("some words and some more words") == want and len(small.memory) <= 2


def test_empty_table(spark):
    assert count_tokens(frame(spark, []), (PIECES, [])).collect() == []
