"""Token counts by the best segmentation into pieces of a unigram vocabulary.

An Aho-Corasick automaton lists, for every place of a text, the pieces that end there; a running
maximum keeps the best score and the number of pieces of the best path. Of equal scores the
earliest start wins, and so the longest last piece: pieces are tried by their start, and only a
greater score replaces one that stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Segments that a worker remembers, and the longest of them.
MEMORY, LONGEST = 400_000, 48


def read_vocabulary(path: str) -> tuple[list[tuple[str, float]], list[tuple[str, float]]]:
    """(pieces that match text, other pieces), with scores, of a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    text, other = [], []
    for i in range(model.vocab_size()):
        special = model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
        (other if special else text).append((model.id_to_piece(i), model.get_score(i)))
    return text, other


class Counter:
    """Pieces and score of the best segmentation; scores are summed in double precision.

    A character that no piece of one character matches may stand for itself with the least score
    of the vocabulary less a penalty; it counts as its UTF-8 bytes where the vocabulary has the
    byte pieces, and else a run of such characters is one piece.
    """

    def __init__(self, pieces: list[tuple[str, float]], other: list[tuple[str, float]] = ()):
        self.machine = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.machine.add_word(piece, (len(piece), score))
        if len(self.machine):
            self.machine.make_automaton()
        self.unknown = min([s for _, s in [*pieces, *other]], default=0.0) - UNKNOWN_PENALTY
        self.bytes = {f"<0x{i:02X}>" for i in range(256)} <= {p for p, _ in other}
        self.single = {p for p, _ in pieces if len(p) == 1}
        # No piece spans the place before a space mark that follows something else: the best
        # segmentation of a text is that of its parts between such places.
        self.parts = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if not any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _ in pieces) else "(?s:.+)")
        self.memory: dict[str, tuple[int, float]] = {}

    def best(self, text: str) -> tuple[int, float]:
        """(pieces, score) of the best path through ``text``, taken as it is."""
        n = len(text)
        score, count, open_ = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        ends = self.machine.iter(text) if len(self.machine) else iter(())
        nxt = next(ends, None)
        for end in range(1, n + 1):
            top = None
            while nxt is not None and nxt[0] == end - 1:
                size, s = nxt[1]  # the longest comes first
                s += score[end - size]
                if top is None or s > top:
                    top, count[end] = s, count[end - size] + 1
                nxt = next(ends, None)
            c = text[end - 1]
            if c not in self.single:
                s = score[end - 1] + self.unknown
                if top is None or s > top:
                    top, open_[end] = s, True
                    count[end] = count[end - 1] + (len(c.encode()) if self.bytes else not open_[end - 1])
            score[end] = top
        return count[n], score[n]

    def count(self, text: str | None) -> tuple[int, float]:
        """(pieces, score) of a text: spaces become marks, and one mark stands before it."""
        if not text:
            return 0, 0.0
        memory, pieces, total = self.memory, 0, 0.0
        for part in self.parts.findall(SPACE + text.replace(" ", SPACE)):
            found = memory.get(part)
            if found is None:
                found = self.best(part)
                if len(part) <= LONGEST:
                    if len(memory) >= MEMORY:
                        memory.clear()
                    memory[part] = found
            pieces += found[0]
            total += found[1]
        return pieces, total


_counters: dict = {}


def count_tokens(docs: DataFrame, vocabulary: str | tuple | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, n_tokens, score) of every row of ``docs``.

    ``vocabulary`` is the path of a SentencePiece file, read by the driver and sent to the tasks, or
    (pieces, other pieces) themselves; its pieces and scores are used as a unigram vocabulary.
    Runs of unknown characters across parts count apart without byte pieces.

    A null or empty text has 0 tokens and score 0. Rows stay one for one, null and repeated ids
    included; other columns are not read.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary) if isinstance(vocabulary, str) else vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _counters.get("words") is not shared.value:
            _counters.update(words=shared.value, counter=Counter(*shared.value))
        count = _counters["counter"].count
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, batch.num_rows, 256):
                found = [(len(t or ""), *count(t)) for t in texts.slice(at, 256).to_pylist()]
                chars, pieces, score = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 256), pa.array(chars, pa.int64()), pa.array(pieces, pa.int64()), pa.array(score, pa.float64())],
                    ["doc_id", "n_chars", "n_tokens", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_chars long, n_tokens long, score double")
