"""Benchmark passages in documents, found by a generalised suffix automaton of the items.

The automaton of one part of the items is sent to all tasks; it follows the words of every
document and knows at each word the longest match that ends there. Items beyond the size of one
part are matched by further passes over the same rows, which need no shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import ALNUM, LOWER, chunks, parts, spans, word_hashes

#: Characters of items that one automaton holds.
PART_CHARS = 1_000_000


class Automaton:
    """Suffix automaton of word sequences; each state knows the items its windows occur in."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.window = window
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        found: list[set[str]] = [set() for _ in self.next]
        ends: dict[int, set[tuple[int, str]]] = {}
        for name, words in items:
            state = 0
            for w in words:
                state = self.next[state][w]
                at = state
                while at > 0 and name not in found[at]:
                    found[at].add(name)
                    at = self.link[at]
            if 0 < len(words) < window:
                ends.setdefault(state, set()).add((len(words), name))
        # The state that stands for the last ``window`` words of a longer match.
        self.top = [-1] * len(self.next)
        self.short: list[tuple[tuple[int, str], ...]] = [()] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            up = self.link[s]
            if self.length[s] >= window:
                self.top[s] = s if self.length[up] < window else self.top[up]
            self.short[s] = self.short[up] + tuple(sorted(ends.get(s, ())))
        self.items = {s: tuple(sorted(found[s])) for s in set(self.top) if s >= 0}
        lengths = [window] * bool(self.items) + [m for marks in ends.values() for m, _ in marks]
        self.shortest = min(lengths, default=0)

    def _new(self, length: int, link: int, after: dict[int, int]) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:  # an earlier item begins in the same way
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        state, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return state

    def matches(self, words: list[int]) -> Iterator[tuple[int, int, tuple[str, ...]]]:
        """(first word, end, items) of every window that occurs in ``words``."""
        after, link, length, window, short, top = self.next, self.link, self.length, self.window, self.short, self.top
        state = run = 0
        for i, w in enumerate(words):
            to = after[state].get(w)
            while to is None and state:
                state = link[state]
                run = length[state]
                to = after[state].get(w)
            if to is None:
                continue
            state, run = to, run + 1
            if run >= window:
                # ``run`` may end inside the state, so its own length is no proof; the top state is.
                yield i + 1 - window, i + 1, self.items[top[state]]
            for m, name in short[state]:
                if m <= run:
                    yield i + 1 - m, i + 1, (name,)


def item_words(text: str | None) -> list[bytes]:
    """Words of one item: runs of letters a-z, digits and non-ASCII characters, A-Z lower-cased."""
    data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _ = spans(data, np.array([0, len(data)]), ALNUM)
    raw = data.tobytes()
    return [raw[s:e] for s, e in zip(starts, ends, strict=True)]


def _find(shared):
    """Adds what one automaton finds to (doc_id, text, n_words, hits, items)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known, numbers = shared.value
        for batch in parts(batches):
            n = batch.num_rows
            total = np.zeros(n, np.int64)
            hits: list[list[dict]] = batch.column("hits").to_pylist()
            names: list[list[str]] = batch.column("items").to_pylist()
            for low, _, data, offsets in chunks(batch.column("text")):
                data = LOWER[data]
                starts, ends, first = spans(data, offsets, ALNUM)
                total[low : low + len(offsets) - 1] = np.diff(first)
                if not len(starts) or not automaton.shortest:
                    continue
                hashes = word_hashes(data, starts, ends)
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                words = np.where(known[at] == hashes, numbers[at], -1)
                # Only runs of item words, as long as the shortest window, can hold a match.
                edge = np.zeros(len(words) + 1, bool)
                edge[first] = True
                inside = words >= 0
                begin, end = inside.copy(), inside.copy()
                begin[1:] &= ~inside[:-1] | edge[1:-1]
                end[:-1] &= ~inside[1:] | edge[1:-1]
                begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
                long = end - begin >= automaton.shortest
                rows = np.searchsorted(first, begin, "right") - 1
                for a, b, row in zip(begin[long].tolist(), end[long].tolist(), rows[long].tolist(), strict=True):
                    for p, q, which in automaton.matches(words[a:b].tolist()):
                        base, text = int(first[row]), int(offsets[row])
                        hits[low + row].append({
                            "word": a + p - base, "end_word": a + q - base,
                            "start": int(starts[a + p]) - text, "end": int(ends[a + q - 1]) - text})
                        names[low + row].extend(which)
            merged = [_merged(x) if x else x for x in hits]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), pa.array(total), pa.array(merged, HIT_ARROW),
                 pa.array([sorted(set(x)) for x in names], pa.list_(pa.string()))],
                ["doc_id", "text", "n_words", "hits", "items"])

    return run


HIT = "array<struct<word: bigint, end_word: bigint, start: bigint, end: bigint>>"
HIT_ARROW = pa.list_(pa.struct([(x, pa.int64()) for x in ("word", "end_word", "start", "end")]))


def _merged(hits: list[dict]) -> list[dict]:
    """Overlapping and touching hits as one."""
    out: list[dict] = []
    for h in sorted(hits, key=lambda x: (x["word"], x["end_word"])):
        if out and h["word"] <= out[-1]["end_word"]:
            if h["end_word"] > out[-1]["end_word"]:
                out[-1] |= {"end_word": h["end_word"], "end": h["end"]}
        else:
            out.append(dict(h))
    return out


def _automata(spark: SparkSession, items: DataFrame, window: int) -> list:
    """Broadcasts of (automaton, word hashes, their numbers), one for each part of the items."""
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.filter("item_id is not null and text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    pieces = max(1, -(-size // PART_CHARS))
    out = []
    for part in range(pieces):
        vocabulary: dict[bytes, int] = {}
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(pieces)) == part).collect()
        coded = [(r["item_id"], [vocabulary.setdefault(w, len(vocabulary)) for w in item_words(r["text"])]) for r in mine]
        data = np.frombuffer(b" ".join(vocabulary), np.uint8)
        starts, ends, _ = spans(data, np.array([0, len(data)]), ALNUM)
        hashes = word_hashes(data, starts, ends)
        order = np.argsort(hashes)
        out.append(spark.sparkContext.broadcast((Automaton([x for x in coded if x[1]], window), hashes[order], order)))
    return out


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_words, hits, items) of every row of ``docs``.

    A window is ``window`` consecutive words of an item, or the whole item when it is shorter.
    ``hits`` are the merged spans of words inside an occurrence, as word numbers and as byte
    offsets into the UTF-8 text; ``items`` are the item ids with an occurring window, as strings.

    A null or empty text has no words and no hits. An item without words, or without item_id,
    takes no part; items that repeat an id count as one. With no items nothing is hit. Other
    columns are not read; rows stay one for one, null and repeated ids included.
    """
    out = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast(HIT).alias("hits"), F.array().cast("array<string>").alias("items"))
    schema = T.StructType([*out.schema.fields])
    for shared in _automata(docs.sparkSession, items, window):
        out = out.mapInArrow(_find(shared), schema)
    return out


def _rule(hits: str = "hits") -> F.Column:
    return F.coalesce(F.aggregate(hits, F.lit(0).cast("bigint"), lambda s, h: s + h["end_word"] - h["word"]), F.lit(0).cast("bigint"))


def report(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """Counts per document; it is contaminated when ``share`` times its hit words reach its words."""
    found = contamination(docs, items, window)
    return found.select(
        "doc_id", "n_words", _rule().alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.expr(f"n_hit > 0 and {share} * n_hit >= n_words"))


def _cleaner(inner, names: list[str], share: int, action: str):
    """Rows of ``docs`` without contaminated rows, or with their hit spans taken out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            at = names.index("text")
            n = batch.num_rows
            probe = pa.RecordBatch.from_arrays(
                [pa.nulls(n, pa.int64()), batch.column(at), pa.array([0] * n, pa.int64()),
                 pa.array([[]] * n, HIT_ARROW), pa.array([[]] * n, pa.list_(pa.string()))],
                ["doc_id", "text", "n_words", "hits", "items"])
            found = probe
            for step in inner:
                found = next(step(iter([found])))
            hits, words = found.column("hits").to_pylist(), found.column("n_words").to_pylist()
            bad = [0 < sum(h["end_word"] - h["word"] for h in x) and share * sum(h["end_word"] - h["word"] for h in x) >= w
                   for x, w in zip(hits, words, strict=True)]
            columns = list(batch.columns)
            if action == "cut" and any(bad):
                texts = columns[at].to_pylist()
                for i in np.flatnonzero(bad).tolist():
                    texts[i] = _without(texts[i].encode(), hits[i]).decode()
                columns[at] = pa.array(texts, columns[at].type)
            out = pa.RecordBatch.from_arrays(columns, names)
            yield out if action == "cut" else out.filter(pa.array([not x for x in bad]))

    return run


def _without(raw: bytes, hits: list[dict]) -> bytes:
    out, last = [], 0
    for h in hits:
        out.append(raw[last : h["start"]])
        last = h["end"]
    return b"".join([*out, raw[last:]])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20, action: str = "drop") -> DataFrame:
    """``docs`` with all its columns, contaminated documents dropped or their hit spans cut out.

    The rule is that of ``report``. Documents with matches below the limit stay as they are.
    No row is shuffled.
    """
    if action not in ("drop", "cut"):
        raise ValueError(f"unknown action {action!r}")
    spark = docs.sparkSession
    steps = [_find(x) for x in _automata(spark, items, window)]
    return docs.mapInArrow(_cleaner(steps, docs.columns, share, action), docs.schema)
