"""Language identification by prediction by partial matching.

Per language, the bytes that followed every context of up to ``ORDER`` bytes in its learning
texts are counted, then frozen. A text's code length under a language is the sum over its bytes
of -log2 of their probability in the longest context that was seen, an escape to the next shorter
context being paid by the share of distinct bytes (method C): with T bytes of D kinds after a
context, a byte seen n times costs -log2(n / (T + D)) and an escape -log2(D / (T + D)); beyond
the empty context every byte costs 8 bits. The language of the least code length wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut
from .words import LOWER, chunks, mix, parts

#: Longest context in bytes, and bytes of a worker's memory of code lengths, and of one piece of work.
ORDER, MEMORY, WORK = 4, 8 << 20, 4 << 20
#: The learning sample: so many texts of each language, of so many characters each; of a longer
#: text so many pieces at even distances that make up that length.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_PIECES = 250, 20_000, 10
#: Languages whose shares are sent to all tasks; more are joined by a shuffle.
BROADCAST_LANGS = 10_000
LETTER = np.zeros(256, bool)
LETTER[ord("a") : ord("z") + 1] = True
LETTER[ord("A") : ord("Z") + 1] = True


@dataclass
class Model:
    """Counts of all languages. Keys hold a context, oldest byte highest, and for symbols the byte after it."""

    langs: list[str]
    contexts: list[np.ndarray]
    totals: list[np.ndarray]
    kinds: list[np.ndarray]
    symbols: list[np.ndarray]
    times: list[np.ndarray]


def _keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The ORDER bytes before each byte, and the byte, as one number; zeros stand before a text."""
    key = data.astype(np.uint64)
    for back in range(1, ORDER + 1):
        part = np.zeros(len(data), np.uint64)
        part[back:] = data[:-back] if back < len(data) else []
        for i in range(back):  # the first bytes of each row have no such byte
            at = offsets[:-1] + i
            part[at[(at < offsets[1:])]] = 0
        key |= part << np.uint64(8 * back)
    return key


def fit(texts: list[tuple[str, str]]) -> Model:
    """Frozen counts of (language, text) pairs."""
    langs = sorted({lang for lang, _ in texts})
    by_lang = []
    for lang in langs:
        mine = pa.array([t for name, t in texts if name == lang], pa.string())
        by_lang.append(np.concatenate([_keys(LOWER[d], o) for _, _, d, o in chunks(mine)] or [np.zeros(0, np.uint64)]))
    model = Model(langs, [], [], [], [], [])
    for k in range(ORDER + 1):
        mask = np.uint64((1 << (8 * (k + 1))) - 1)
        counted = [np.unique(keys & mask, return_counts=True) for keys in by_lang]
        symbols = np.unique(np.concatenate([v for v, _ in counted]))
        times = np.zeros((len(symbols), len(langs)), np.int64)
        for i, (v, c) in enumerate(counted):
            times[np.searchsorted(symbols, v), i] = c
        contexts, start = np.unique(symbols >> np.uint64(8), return_index=True)
        model.symbols.append(symbols)
        model.times.append(times)
        model.contexts.append(contexts)
        model.totals.append(np.add.reduceat(times, start, axis=0))
        model.kinds.append(np.add.reduceat((times > 0).astype(np.int64), start, axis=0))
    return model


def costs(model: Model, keys: np.ndarray) -> np.ndarray:
    """Bits of each key's last byte after its context, per language."""
    bits = np.zeros((len(keys), len(model.langs)))
    open_ = np.ones(bits.shape, bool)
    for k in range(ORDER, -1, -1):
        key = keys & np.uint64((1 << (8 * (k + 1))) - 1)
        context = key >> np.uint64(8)
        at = np.minimum(np.searchsorted(model.contexts[k], context), len(model.contexts[k]) - 1)
        known = (model.contexts[k][at] == context)[:, None]
        total, kinds = model.totals[k][at] * known, model.kinds[k][at] * known
        at = np.minimum(np.searchsorted(model.symbols[k], key), len(model.symbols[k]) - 1)
        times = model.times[k][at] * (model.symbols[k][at] == key)[:, None]
        seen = open_ & (total > 0)
        hit = seen & (times > 0)
        whole = np.maximum(total + kinds, 1)
        bits += np.where(hit, -np.log2(np.where(hit, times, 1) / whole), 0)
        escape = seen & ~hit
        bits += np.where(escape, -np.log2(np.where(escape, kinds, 1) / whole), 0)
        open_ &= ~hit
    return bits + 8 * open_


class Scorer:
    """Code lengths of texts, with a memory of the contexts met before (it never changes a result)."""

    def __init__(self, model: Model):
        self.model = model
        self.slots = np.uint64(max(256, MEMORY // (8 * len(model.langs))))
        self.keys = np.full(int(self.slots), np.iinfo(np.uint64).max, np.uint64)
        self.bits = np.zeros((int(self.slots), len(model.langs)))

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each row under each language; long rows are worked through in pieces."""
        keys = _keys(LOWER[data], offsets)
        out = np.zeros((len(offsets) - 1, len(self.model.langs)))
        step = max(256, WORK // (8 * len(self.model.langs)))
        for low in range(0, len(keys), step):
            part = keys[low : low + step]
            first, last = int(np.searchsorted(offsets, low, "right")) - 1, int(np.searchsorted(offsets, low + len(part)))
            at = np.clip(offsets[first : last + 1] - low, 0, len(part))
            out[first:last] += self._sums(part, at)
        return out

    def _sums(self, keys: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        slot = (mix(keys) % self.slots).astype(np.int64)
        miss = np.flatnonzero(self.keys[slot] != keys)
        each = self.bits[slot]
        if len(miss):
            new, back = np.unique(keys[miss], return_inverse=True)
            bits = costs(self.model, new)
            each[miss] = bits[back]
            at = (mix(new) % self.slots).astype(np.int64)
            self.bits[at] = bits
            self.keys[at] = new
            # Of new keys that share a slot, the last one written stays with its own bits.
        total = np.zeros((len(keys) + 1, each.shape[1]))
        np.cumsum(each, axis=0, out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    count = np.concatenate([[0], np.cumsum(LETTER[data])])
    out = count[offsets[1:]] > count[offsets[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode(errors="replace"))
    return out


_scorers: dict = {}


def predictions(shared, column: pa.Array) -> tuple[list[str], list[float]]:
    """(language, probability) of each text; und and 0 without letters or without a model."""
    model = shared.value
    langs: list[str] = ["und"] * len(column)
    scores = [0.0] * len(column)
    if model is None:
        return langs, scores
    if _scorers.get("model") is not model:
        _scorers.update(model=model, scorer=Scorer(model))
    scorer: Scorer = _scorers["scorer"]
    for low, _, data, offsets in chunks(column, 1 << 17):
        bits = scorer.lengths(data, offsets)
        letters = _has_letter(data, offsets)
        best = bits.argmin(axis=1)
        share = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
        for i in np.flatnonzero(letters).tolist():
            langs[low + i] = model.langs[best[i]]
            scores[low + i] = min(1.0, float(share[i]))
    return langs, scores


def _excerpt(text):
    """The text, or ``SAMPLE_PIECES`` pieces of it at even distances when it exceeds the sample's length."""
    size = SAMPLE_CHARS // SAMPLE_PIECES
    room = F.length(text) - size
    pieces = [F.substring(text, F.floor(room * i / (SAMPLE_PIECES - 1)).cast("int") + 1, F.lit(size)) for i in range(SAMPLE_PIECES)]
    return F.when(F.length(text) <= SAMPLE_CHARS, text).otherwise(F.concat_ws(" ", *pieces))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"):
    """The frozen model as a broadcast; None in it when no text can be learned from.

    Learns from texts with a language and a doc_id whose crc32 mod 3 is not 1: of each language
    the SAMPLE_DOCS doc_ids of the least hash, each with its text of the least hash, of which at
    most SAMPLE_CHARS characters are read, from all of its length. A first count of distinct ids
    per language thins the rows by hash, so the ranking window is small at any size.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter("lang is not null and length(text) > 0")
    rows = rows.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    rows = rows.withColumn("order", F.xxhash64(F.lit(10), "doc_id"))
    # Three times the ids that are wanted pass, so a count within some hundredths is enough.
    ids = F.approx_count_distinct("order", 0.05)
    share = rows.groupBy("lang").agg(ids.alias("ids")).withColumn("share", F.least(F.lit(1.0), 3.0 * SAMPLE_DOCS / F.col("ids")))
    share = cut(share.select("lang", "share"), "shares")
    # Rows are thinned where they are read, so no text is shuffled that can't be in the sample.
    few = share.count() <= BROADCAST_LANGS
    thin = rows.join(F.broadcast(share) if few else share, "lang").filter(F.pmod("order", F.lit(1_000_000)) < F.col("share") * 1_000_000)
    thin = thin.withColumn("text_hash", F.xxhash64("text")).withColumn("text", _excerpt(F.col("text")))
    one = thin.groupBy("lang", "order", "doc_id").agg(F.min_by("text", "text_hash").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order", "doc_id"))
    sample = one.withColumn("rank", rank).filter(F.col("rank") <= SAMPLE_DOCS).select("lang", "text").collect()
    sample.sort()
    return docs.sparkSession.sparkContext.broadcast(fit([(r["lang"], r["text"]) for r in sample]) if sample else None)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs``.

    lang_pred is a learned language, or ``und`` with score 0 where the text is null, empty or
    without a letter, and for all rows when nothing can be learned. score is the probability of
    lang_pred among the learned languages, all equally likely beforehand; of equal code lengths
    the first language by name wins. A row without doc_id is neither learned from nor held out.
    Repeated rows give a row each; other columns are not read.
    """
    shared = learn(docs, id_col, text_col, lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            langs, scores = predictions(shared, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    rows = rows.select("doc_id", held.alias("held_out"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` with all its columns, without the rows that are ``und`` or scored below ``least``.

    Null and empty texts go with them, repeated rows are judged alike, and nothing stays of a table
    that nothing can be learned from. ``docs`` has the columns doc_id, text and lang.
    """
    shared = learn(docs)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            langs, scores = predictions(shared, batch.column(names.index("text")))
            keep = [lang != "und" and s >= least for lang, s in zip(langs, scores, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))
        # The next stage may run in the same worker.
        _scorers.clear()

    return docs.mapInArrow(run, docs.schema)
