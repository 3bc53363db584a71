"""How far the sources of a language differ in their terms, after an iceberg cut of the vocabulary.

Terms that too few documents of a language hold are never counted whole. Byte prefixes are
extended level by level (3, 9, 27, ... bytes): a prefix that fewer documents hold than the
threshold is discarded with everything that begins with it, the others are extended, until only
complete terms remain. A level is one pass over the distinct terms of each document; the prefixes
of the level before are known to all tasks as a bitmap of fixed size. The bitmap may let a
discarded prefix through, whose extensions are then discarded by their own counts, so the kept
terms are exact.

Counts travel as packed arrays, one row for a block of terms and a slice of documents, and are
summed as a stream of such rows in order of block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Bytes of the first prefixes, and what each level multiplies them by.
FIRST, FACTOR = 3, 3
#: Cells of the bitmap of kept prefixes, a power of two: 2 MB whatever the vocabulary.
CELLS = 1 << 24
#: Bytes of text cut into terms, and terms of documents counted, at a time in a task.
SLICE_BYTES, SLICE_TERMS = 8 << 20, 1 << 20
#: Blocks that the terms of a language are dealt to, and entries that a stream holds unsummed.
BLOCKS, WAITING = 256, 1 << 20
#: Terms compared at a time, and sources of a language in one tile of pairs.
BLOCK_TERMS, TILE_SOURCES = 4096, 256

#: A-Z to a-z; a-z and every byte of a non-ASCII character stand; all else ends a term.
_TERM_BYTES = bytes(
    b + 32 if ord("A") <= b <= ord("Z") else b if ord("a") <= b <= ord("z") or b >= 0x80 else 0x20 for b in range(256))
_END = b"\0"

#: Terms, each ended by a zero byte, in order; their counts as 32-bit numbers.
BAG = "lang string, source string, terms binary, counts binary"
#: Terms of a block, ended by zero bytes; entries of (term, source, n, documents).
PACKED = "lang string, block int, terms binary, sources array<string>, term_of binary, source_of binary, n binary, docs binary"


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct terms of each document and their counts."""
    for batch in batches:
        low = 0
        while low < batch.num_rows:
            high, size, terms, counts = low, 0, [], []
            while high < batch.num_rows and (high == low or size < SLICE_BYTES):
                raw = batch.column(2)[high].as_py()
                bag: dict[bytes, int] = {}
                for t in raw.translate(_TERM_BYTES).split():
                    bag[t] = bag.get(t, 0) + 1
                names = sorted(bag)
                terms.append(_END.join([*names, b""]))
                counts.append(np.array([bag[t] for t in names], np.int32).tobytes())
                size += len(raw)
                high += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low),
                 pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], ["lang", "source", "terms", "counts"])
            low = high


def bags(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The bag of terms of every row; null text, lang and source are empty."""
    def plain(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    return docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source"), plain(text_col).cast("binary").alias("text")).mapInArrow(_bags, BAG)


def _terms(data: np.ndarray) -> pa.Array:
    """The terms in a run of bytes, each with the zero byte that ends it."""
    ends = np.flatnonzero(data == 0).astype(np.int64) + 1
    where = np.concatenate([np.zeros(1, np.int64), ends])
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(where), pa.py_buffer(data)])


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[str, list, np.ndarray, pa.Array, np.ndarray]]:
    """(lang, source of each row, row of each term, terms, counts) of parts of one language each."""
    langs = batch.column("lang").to_pylist()
    order = sorted(range(len(langs)), key=langs.__getitem__)
    low = 0
    while low < len(order):
        rows, size, blobs, counts = [], 0, [], []
        lang = langs[order[low]]
        while low < len(order) and langs[order[low]] == lang and (not rows or size < SLICE_TERMS):
            i = order[low]
            blobs.append(batch.column("terms")[i].as_py())
            counts.append(batch.column("counts")[i].as_py())
            rows.append(i)
            size += len(counts[-1]) // 4
            low += 1
        sizes = [len(c) // 4 for c in counts]
        sources = batch.column("source").take(pa.array(rows)).to_pylist()
        yield lang, sources, np.repeat(np.arange(len(rows)), sizes), _terms(np.frombuffer(b"".join(blobs), np.uint8)), np.frombuffer(b"".join(counts), np.int32)


def _coded(column: pa.Array) -> tuple[np.ndarray, list]:
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def _inside(cells: bytes, lang: bytes, prefix: bytes) -> bool:
    at = crc32(prefix, crc32(lang + _END)) % (8 * len(cells))
    return bool(cells[at >> 3] >> (at & 7) & 1)


def _packed(lang: str, terms: list[bytes], sources: list[str], term_of, source_of, n, docs) -> list[tuple]:
    """Rows of PACKED: the entries dealt to blocks by the terms they name."""
    block_of = np.fromiter((crc32(t) % BLOCKS for t in terms), np.int64, len(terms))
    by_block = np.argsort(block_of, kind="stable")
    place = np.empty(len(terms), np.int64)
    blocks, starts = np.unique(block_of[by_block], return_index=True)
    ends = np.append(starts[1:], len(terms))
    place[by_block] = np.arange(len(terms)) - np.repeat(starts, ends - starts)
    order = np.argsort(block_of[term_of], kind="stable")
    edges = np.searchsorted(block_of[term_of][order], np.append(blocks, BLOCKS))
    columns = [x[order] for x in (place[term_of].astype(np.int32), source_of.astype(np.int32), n.astype(np.int64), docs.astype(np.int64))]
    return [
        (lang, int(b), b"".join([terms[i] for i in by_block[s:e]]), sources, *(c[edges[k] : edges[k + 1]].tobytes() for c in columns))
        for k, (b, s, e) in enumerate(zip(blocks, starts, ends, strict=True))]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.binary(), pa.list_(pa.string()), *[pa.binary()] * 4]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], [c.split()[0] for c in PACKED.split(", ")])


def _level(length: int, before: int, parents) -> Callable:
    """Documents that hold each prefix of ``length`` bytes whose first ``before`` bytes may be kept.

    The zero byte of a shorter term is part of its prefix: such a term is complete, and is counted
    at one level only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = parents.value if parents is not None else None
        for batch in batches:
            for lang, _, rows, terms, _ in _slices(batch):
                term_of, names = _coded(terms)
                if not names:
                    continue
                if cells is None:
                    keep = np.ones(len(names), bool)
                else:
                    parent_of, above = _coded(pa.array([t[:before] for t in names], pa.binary()))
                    keep = np.fromiter((p[-1] != 0 and _inside(cells, lang.encode(), p) for p in above), bool, len(above))[parent_of]
                if not keep.any():
                    continue
                prefix_of, prefixes = _coded(pa.array([t[:length] for t, k in zip(names, keep.tolist(), strict=True) if k], pa.binary()))
                number = np.full(len(names), -1, np.int64)
                number[keep] = prefix_of
                held = number[term_of]
                rows, held = rows[held >= 0], held[held >= 0]
                # Terms of a document are in order, so equal prefixes are neighbours.
                new = np.ones(len(held), bool)
                new[1:] = (held[1:] != held[:-1]) | (rows[1:] != rows[:-1])
                docs = np.bincount(held[new], minlength=len(prefixes))
                zero = np.zeros(len(prefixes), np.int64)
                # Prefixes are ended like terms: a complete one already is.
                yield _batch(_packed(lang, [p if p[-1] == 0 else p + _END for p in prefixes], [""], np.arange(len(prefixes)), zero, (
                    np.fromiter((p[-1] == 0 for p in prefixes), bool, len(prefixes))), docs))

    return run


class _Sum:
    """Entries of one block, summed whenever many are waiting."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, terms: bytes, sources: list[str], *entries: bytes) -> None:
        kinds = (np.int32, np.int32, np.int64, np.int64)
        columns = [np.frombuffer(x, t) for x, t in zip(entries, kinds, strict=True)]
        self.parts.append((np.frombuffer(terms, np.uint8), sources, *columns))
        self.size += len(columns[0])
        if self.size > WAITING:
            names, where, *rest = self.total()
            self.parts = [(np.frombuffer(b"".join(names), np.uint8), where, *rest)]
            # What stays after summing does not count against the next rows.
            self.size = 0

    def total(self) -> tuple:
        """(terms, sources, term_of, source_of, n, docs), one entry for each term and source."""
        terms = pa.concat_arrays([_terms(p[0]) for p in self.parts])
        term_of, names = _coded(terms)
        source_of, sources = _coded(pa.array([s for p in self.parts for s in p[1]], pa.string()))
        at_term = np.cumsum([0, *(int(np.count_nonzero(p[0] == 0)) for p in self.parts[:-1])])
        at_source = np.cumsum([0, *(len(p[1]) for p in self.parts[:-1])])
        t = term_of[np.concatenate([p[2] + a for p, a in zip(self.parts, at_term, strict=True)])]
        s = source_of[np.concatenate([p[3] + a for p, a in zip(self.parts, at_source, strict=True)])]
        key, place = np.unique(t * len(sources) + s, return_inverse=True)
        sums = []
        for i in (4, 5):
            out = np.zeros(len(key), np.int64)
            np.add.at(out, place, np.concatenate([p[i] for p in self.parts]))
            sums.append(out)
        t, s = np.divmod(key, len(sources))
        return names, sources, t, s, *sums


def _summed(told: Callable) -> Callable:
    """A stream of PACKED rows in order of block; ``told`` gives the batches of each block's sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, _Sum()
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                row = [c[i].as_py() for c in columns]
                if last is not None and (row[0], row[1]) != last:
                    yield from told(*last, *held.total())
                    held = _Sum()
                last = (row[0], row[1])
                held.add(*row[2:])
        if last is not None:
            yield from told(*last, *held.total())

    return run


def _streamed(rows: DataFrame, told: Callable, schema: str) -> DataFrame:
    return rows.repartition("lang", "block").sortWithinPartitions("lang", "block").mapInArrow(_summed(told), schema)


def _kept_prefixes(least: int) -> Callable:
    def told(lang, block, names, sources, term_of, source_of, n, docs) -> Iterator[pa.RecordBatch]:
        keep = np.flatnonzero(docs >= least)
        # The sum of n tells whether the prefix is complete; if not, its zero byte is not its own.
        ready = n[keep] > 0
        found = [names[t] if r else names[t][:-1] for t, r in zip(term_of[keep].tolist(), ready.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(found), pa.string()), pa.array(found, pa.binary()), pa.array(ready, pa.bool_())], ["lang", "prefix", "complete"])

    return told


def _bitmap(kept: DataFrame) -> bytes:
    """The cells of the rows of (lang, prefix): at most CELLS / 64 rows reach the driver."""
    key = F.concat(F.encode("lang", "utf-8"), F.lit(_END), F.col("prefix"))
    cell = kept.select(F.pmod(F.crc32(key), F.lit(CELLS)).alias("at"))
    words = cell.groupBy(F.shiftright("at", 6).cast("int").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(CELLS // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.astype("<i8").tobytes()


def kept_terms(bag: DataFrame, least: int = 3) -> DataFrame:
    """(lang, prefix): the terms, ended by a zero byte, that ``least`` documents of the language hold or more."""
    spark, before, length, parents, out = bag.sparkSession, 0, FIRST, None, None
    rows = bag.select("lang", "source", "terms", "counts")
    while True:
        found = rows.mapInArrow(_level(length, before, parents), PACKED)
        kept = cut(_streamed(found, _kept_prefixes(least), "lang string, prefix binary, complete boolean"), "prefixes")
        done = kept.filter("complete").select("lang", "prefix")
        out = done if out is None else out.unionByName(done)
        more = kept.filter("NOT complete")
        if more.isEmpty():
            return out
        parents = spark.sparkContext.broadcast(_bitmap(more))
        before, length = length, length * FACTOR


def _counts(cells) -> Callable:
    """Occurrences and documents of the terms that may be kept, by source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, by_row, rows, terms, counts in _slices(batch):
                term_of, names = _coded(terms)
                kept = np.fromiter((_inside(cells.value, lang.encode(), t) for t in names), bool, len(names))
                if not kept.any():
                    continue
                number = np.cumsum(kept) - 1
                source_of, sources = _coded(pa.array(by_row, pa.string()))
                keep = kept[term_of]
                key = source_of[rows[keep]] * int(kept.sum()) + number[term_of[keep]]
                key, place, docs = np.unique(key, return_inverse=True, return_counts=True)
                n = np.zeros(len(key), np.int64)
                np.add.at(n, place, counts[keep])
                source, term = np.divmod(key, int(kept.sum()))
                yield _batch(_packed(lang, [t for t, k in zip(names, kept.tolist(), strict=True) if k], sources, term, source, n, docs))

    return run


def _vocabulary(least: int) -> Callable:
    """PACKED rows of at most BLOCK_TERMS terms that enough documents hold."""

    def told(lang, block, names, sources, term_of, source_of, n, docs) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names), np.int64)
        np.add.at(total, term_of, docs)
        kept = np.flatnonzero(total >= least)
        for low in range(0, len(kept), BLOCK_TERMS):
            part = kept[low : low + BLOCK_TERMS]
            number = np.full(len(names), -1, np.int64)
            number[part] = np.arange(len(part))
            mine = number[term_of] >= 0
            columns = (number[term_of[mine]].astype(np.int32), source_of[mine].astype(np.int32), n[mine], docs[mine])
            yield _batch([(lang, block + BLOCKS * (low // BLOCK_TERMS), b"".join([names[t] for t in part]), sources, *(c.tobytes() for c in columns))])

    return told


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, total, v): occurrences by source; of each block its terms, without a source."""
    for batch in batches:
        rows: list[tuple] = []
        for row in batch.to_pylist():
            sums = np.zeros(len(row["sources"]), np.int64)
            np.add.at(sums, np.frombuffer(row["source_of"], np.int32), np.frombuffer(row["n"], np.int64))
            rows += [(row["lang"], s, int(x), 0) for s, x in zip(row["sources"], sums, strict=True)]
            rows.append((row["lang"], None, 0, row["terms"].count(_END)))
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["lang", "source", "total", "v"])


def scaled(n: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """1 + floor(10^9 (n + 1) / size), exactly while size is below 9 * 10^15: long division by thousands."""
    rest, out = np.asarray(n, np.int64) + 1, np.int64(0)
    out, rest = np.divmod(rest, size)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, size)
        out = out * 1000 + digit
    return out + 1


def _compared(top: int) -> Callable:
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Of one block: sums over its terms for each pair of sources, and the first terms of each source."""
        right = right.sort_values("source", kind="stable").reset_index(drop=True)
        names = right["source"].to_numpy(object)
        number = {x: i for i, x in enumerate(names)}
        mine = np.flatnonzero(right["mine"].to_numpy(bool))
        lang, v = right["lang"].iloc[0], int(right["v"].iloc[0])
        value = np.zeros((len(mine), len(names)), np.int64)
        first: list[tuple] = []
        for row in left.itertuples(index=False):
            terms = row.terms.split(_END)[:-1]
            here = np.array([number[s] for s in row.sources], np.int64)
            term_of, source_of = np.frombuffer(row.term_of, np.int32), here[np.frombuffer(row.source_of, np.int32)]
            n = np.frombuffer(row.n, np.int64)
            size = right["total"].to_numpy(np.int64) + v
            p, none = scaled(n, size[source_of]), scaled(np.zeros(len(names), np.int64), size)
            step = max(1, (1 << 20) // len(names))
            for low in range(0, len(terms), step):
                here = (term_of >= low) & (term_of < low + step)
                all_p = np.repeat(none[:, None], min(step, len(terms) - low), axis=1)
                all_p[source_of[here], term_of[here] - low] = p[here]
                for i, g in enumerate(mine.tolist()):
                    away = all_p[g] - all_p
                    value[i] += (away * away // all_p).sum(axis=1)
            whole = np.zeros(len(terms), np.int64)
            np.add.at(whole, term_of, n)
            q = scaled(whole, int(right["all_total"].iloc[0]) + v)[term_of]
            above = (p > q) & right["mine"].to_numpy(bool)[source_of]
            f = (p - q) * (p - q) // q
            for g in np.unique(source_of[above]).tolist():
                at = np.flatnonzero(above & (source_of == g))
                best = sorted(zip((-f[at]).tolist(), [terms[t] for t in term_of[at]], strict=True))[:top]
                first += [(lang, names[g], "term", t.decode(), -x) for x, t in best]
        g, h = np.divmod(np.arange(value.size), max(len(names), 1))
        other = mine[g] != h
        pairs = pd.DataFrame({"lang": lang, "source": names[mine[g]][other], "part": "pair", "item": names[h][other], "value": value.ravel()[other]})
        return pd.concat([pairs, pd.DataFrame(first, columns=list(pairs.columns))]) if first else pairs

    return run


def divergence(docs: DataFrame, least: int = 3, top: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): how far a source is from the others, and in which terms.

    Terms are runs of A-Z, a-z and non-ASCII characters, A-Z lower-cased; a language keeps those
    that ``least`` of its documents hold, a document being a row. A (lang, source) gives each kept
    term p = 1 + floor(10^9 (n + 1) / (N + V)) from its n occurrences there, N of kept terms in
    all and V kept terms. Part ``pair``: the sum of floor((p - q)^2 / q) over all kept terms, q of
    the other source ``item``. Part ``term``: that number of one term of the source, q of the whole
    language, where p > q, for the ``top`` first. Ranks go by falling value, then by item.

    Null text, lang and source are empty strings; an empty or term-less text adds its group, whose
    terms all count 0. Without kept terms the pairs are 0. Very long texts are taken whole; rows that
    repeat count each; ties of value go by the bytes of the item. Other columns are not read, so
    their names can't clash. An empty table gives no rows.

    Blocks of terms are compared in tasks of their own, for all pairs of a tile at once; only sums
    leave them, and of each source no more terms than the result may hold.
    """
    spark = docs.sparkSession
    bag = cut(bags(docs, text_col, lang_col, source_col), "bags")
    cells = spark.sparkContext.broadcast(_bitmap(kept_terms(bag, least)))
    counted = cut(_streamed(bag.mapInArrow(_counts(cells), PACKED), _vocabulary(least), PACKED), "counts")

    sizes = counted.select("lang", "terms", "sources", "source_of", "n").mapInArrow(
        _sizes, "lang string, source string, total long, v long")
    sizes = cut(sizes, "sizes")
    totals = sizes.filter("source is not null").groupBy("lang", "source").agg(F.sum("total").alias("total"))
    groups = bag.select("lang", "source").distinct().join(totals, ["lang", "source"], "left")
    groups = groups.join(sizes.groupBy("lang").agg(F.sum("v").alias("v")), "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"))
    wide = groups.groupBy("lang").agg(F.sum("total").alias("all_total"), F.ceil(F.count(F.lit(1)) / TILE_SOURCES).cast("int").alias("tiles"))
    groups = cut(groups.join(wide, "lang").withColumn("own", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")), "groups")

    # Blocks are dealt to pieces of about BLOCK_TERMS terms, and every source meets every piece.
    every = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("v") / BLOCK_TERMS).cast("int"))
    right = groups.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1))).withColumn("tile", every)
    right = right.withColumn("mine", F.col("own") == F.col("tile"))
    left = counted.join(groups.select("lang", "tiles", "v").distinct(), "lang")
    left = left.withColumn("piece", F.pmod(F.col("block"), pieces)).withColumn("tile", every)
    keys = ["lang", "piece", "tile"]
    found = left.select(*keys, "terms", "sources", "term_of", "source_of", "n").groupBy(*keys).cogroup(
        right.select(*keys, "source", "total", "all_total", "v", "mine").groupBy(*keys)
    ).applyInPandas(_compared(top), "lang string, source string, part string, item string, value long")
    found = cut(found, "found")
    falling = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = pairs.withColumn("rank", F.row_number().over(falling))
    # First within parts of a source, so that no task ranks all that its blocks named.
    part = Window.partitionBy("lang", "source", F.pmod(F.crc32(F.encode("item", "utf-8")), F.lit(16))).orderBy(F.desc("value"), F.asc("item"))
    terms = found.filter("part = 'term'").withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    terms = terms.withColumn("rank", F.row_number().over(falling)).filter(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.select(*columns).unionByName(terms.select(*columns))
