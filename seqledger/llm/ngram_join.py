"""Jaccard join of word n-gram sets, and the groups its links make.

Documents with the same set are one set of the join. Sets meet in tiles: one tile holds the
sets of one size band, and of the band below, that share a shingle of their prefixes. Prefixes
take the rare shingles first; any two sets that reach the threshold share one, so no link is
lost. Inside a tile the place of the shared shingle and hashed parity bitmaps bound the overlap
from above, and once more wider ones for the pairs of all tiles; only pairs within the bounds go
on to the exact intersection of their sorted arrays. A pair is left to an earlier tile when one of
the last few shingles before this one is shared as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut
from .components import components
from .words import mix, parts, shingle_sets

#: Longs of the bitmap that goes through the tiles, and cells at most of the wide one, which has
#: about one cell for each member and is looked up for the pairs that a tile lets through.
BITMAP, WIDE = 8, 1 << 16
#: A shingle counted so often in one chunk of texts is reported as frequent, and so many of the
#: most frequent are known to all tasks. Both only order the prefixes; the links are the same.
SEEN, FREQUENT = 3, 1 << 17
#: Rows of one side of a tile that one task takes before the tile is split.
TILE_ROWS = 2048
#: Shingles of earlier tiles that a set carries into a tile.
BEFORE = 4
#: Set ids that are sent to all tasks; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _prints(values: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    with np.errstate(over="ignore"):
        a = np.bitwise_xor.reduce(mix(values)) + np.uint64(len(values))
        b = np.add.reduce(mix(values ^ np.uint64(0x5851F42D4C957F2D)))
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _parity(values: np.ndarray, cells: int) -> np.ndarray:
    """Parity of the number of members in each of ``cells`` cells, a power of two, as bytes."""
    odd = np.bincount((mix(values) >> np.uint64(40)).astype(np.int64) & (cells - 1), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8))


def _bitmap(values: np.ndarray) -> list[int]:
    return _parity(values, 64 * BITMAP).view(np.int64).tolist()


def _wide(values: np.ndarray) -> bytes:
    return _parity(values, min(WIDE, max(64, 1 << (len(values) - 1).bit_length()))).tobytes()


def _differing(a: bytes, b: bytes) -> int:
    """Cells whose parities differ; the larger bitmap is folded to the size of the other."""
    p, q = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(p) > len(q):
        p = p[: len(p) // 2] ^ p[len(p) // 2 :]
    while len(q) > len(p):
        q = q[: len(q) // 2] ^ q[len(q) // 2 :]
    return int(np.bitwise_count(p ^ q).sum())


def _summaries(k: int):
    """Rows of two kinds: (doc_id, n, a, b) of every document, (shingle, count) of frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            waiting: list[np.ndarray] = []
            size = 0

            def count() -> list[tuple]:
                if not waiting:
                    return []
                values, times = np.unique(np.concatenate(waiting), return_counts=True)
                waiting.clear()
                keep = times >= SEEN
                return [(1, int(v), int(t), 0, 0) for v, t in zip(values[keep].astype(np.int64), times[keep], strict=True)]

            for i, values in shingle_sets(batch.column(1), k):
                a, b = _prints(values) if len(values) else (0, 0)
                rows.append((0, ids[i], len(values), a, b))
                if len(values) > 1:
                    waiting.append(values)
                    size += len(values)
                if size > 500_000:
                    rows += count()
                    size = 0
            rows += count()
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5,
                ["kind", "key", "n", "a", "b"])

    return run


def prefix_length(n: int, percent: int) -> int:
    """Members of a set of ``n`` of which one must be in any set it reaches ``percent`` with."""
    return n - -(-percent * n // 100) + 1


def _prefixes(k: int, percent: int, frequent, counts):
    """(a, b, doc_id, n, bitmap, prefix) of every document with a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = frequent.value, counts.value
        for batch in parts(batches):
            ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for i, values in shingle_sets(batch.column(1), k):
                n = len(values)
                if not n or ids[i] is None:
                    continue
                take = prefix_length(n, percent)
                prefix = values
                if len(known):
                    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
                    weight = np.where(known[at] == values, often[at], 0)
                    if weight.any():
                        prefix = values[np.lexsort((values, weight))]
                rows.append((*_prints(values), ids[i], n, *_bitmap(values), _wide(values), prefix[:take].astype(np.int64)))
            kinds = [pa.int64()] * (4 + BITMAP) + [pa.binary(), pa.list_(pa.int64())]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(columns, kinds, strict=True)],
                ["a", "b", "doc_id", "n", *[f"s{i}" for i in range(BITMAP)], "wide", "prefix"])

    return run


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) with the text compressed: the exact check moves texts twice."""
    press = zstandard.ZstdCompressor(level=3).compress
    for batch in parts(batches):
        packed = [press((x or "").encode()) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["doc_id", "text"])


def _verified(k: int, percent: int):
    """The pairs (x, y) whose exact intersection reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        unpack = zstandard.ZstdDecompressor().decompress

        def members(raw: bytes) -> np.ndarray:
            return next(shingle_sets(pa.array([unpack(raw)], pa.binary()), k))[1]

        for batch in batches:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            keep: list[int] = []
            left, right = batch.column("text_x"), batch.column("text_y")
            for i in range(batch.num_rows):
                if last[0] != x[i]:
                    last = (x[i], members(left[i].as_py()))
                other = members(right[i].as_py())
                p, q = (last[1], other) if len(last[1]) <= len(other) else (other, last[1])
                if len(p):
                    at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                    both = int(np.count_nonzero(q[at] == p))
                    if 100 * both >= percent * (len(p) + len(q) - both):
                        keep.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for i in keep], pa.int64()), pa.array([y[i] for i in keep], pa.int64())], ["x", "y"])

    return run


def only_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is in ``ids``; the ids are broadcast when counted few."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def _possible(percent: int):
    """The pairs (x, y) that their wide bitmaps let reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, p, q = (batch.column(c).to_pylist() for c in ("n_x", "n_y", "wide_x", "wide_y"))
            keep = [(100 + percent) * (a + b - _differing(u, v)) >= 2 * percent * (a + b) for a, b, u, v in zip(n, m, p, q, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], ["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return run


def _check(pairs: DataFrame, sets: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The links among ``pairs``: bounded by the wide bitmaps, then by intersection of the sets."""
    wide = sets.select("id", "n", "wide")
    near = pairs.join(wide.select(F.col("id").alias("x"), F.col("n").alias("n_x"), F.col("wide").alias("wide_x")), "x")
    near = near.join(wide.select(F.col("id").alias("y"), F.col("n").alias("n_y"), F.col("wide").alias("wide_y")), "y")
    near = cut(near.mapInArrow(_possible(percent), "x long, y long").distinct(), "near")
    ids = cut(near.select(F.col("x").alias("doc_id")).unionByName(near.select(F.col("y").alias("doc_id"))).distinct(), "ids")
    texts = only_ids(docs, ids).mapInArrow(_compressed, "doc_id long, text binary")
    # Of rows that repeat a doc_id each may be the one of the set; all are checked.
    texts = cut(texts.distinct(), "texts")
    full = near.join(texts.select(F.col("doc_id").alias("y"), F.col("text").alias("text_y")), "y")
    full = full.join(texts.select(F.col("doc_id").alias("x"), F.col("text").alias("text_x")), "x")
    return cut(full.select("x", "y", "text_x", "text_y").mapInArrow(_verified(k, percent), "x long, y long"), "links")


def _bounded(p: str, q: str, percent: int) -> str:
    """SQL: sizes and bitmaps let the pair reach the threshold.

    Each differing parity bit is a member that one side has alone, so the union exceeds the
    intersection by that number at least: the overlap is (n + m - bits) / 2 at most.
    """
    bits = " + ".join(f"bit_count({p}.s{i} ^ {q}.s{i})" for i in range(BITMAP))
    both = f"({p}.n + {q}.n - ({bits}))"
    sizes = f"100 * least({p}.n, {q}.n) >= {percent} * greatest({p}.n, {q}.n)"
    return f"{sizes} AND {100 + percent} * {both} >= {2 * percent} * ({p}.n + {q}.n)"


def _placed(p: str, q: str, percent: int) -> str:
    """SQL: what stands from the shared shingle on can reach the threshold.

    In the tile of the first shingle two sets share, by the common order of prefixes, all that
    they share stands there or behind. So a linked pair passes in that tile at least.
    """
    rest = f"least({p}.n - {p}.pos, {q}.n - {q}.pos)"
    return f"{100 + percent} * {rest} >= {percent} * ({p}.n + {q}.n)"


def _earlier(p: str, q: str) -> str:
    """SQL: the sets are known to meet in an earlier tile.

    The first tile in which two sets meet has none of their shingles before it in common, so it
    never leaves them to another.
    """
    return "coalesce(" + " OR ".join(f"{p}.b{i} = {q}.b{j}" for i in range(BEFORE) for j in range(BEFORE)) + ", false)"


def ngram_groups(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    Words are runs of other characters than ASCII white space, A-Z lower-cased; a set holds the
    distinct ``k``-word shingles, or the whole sequence when there are fewer words. Two documents
    link when the intersection is ``percent`` hundredths of the union or more; component_id is the
    least doc_id that links reach.

    A null or empty text has no shingles and is its own component. A row without doc_id keeps its
    n_shingles, has a null component_id and links nothing. Rows that repeat a doc_id give one row
    each and are one document, with the links of any of its texts. Other columns of ``docs`` are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    summary = cut(docs.mapInArrow(_summaries(k), "kind long, key long, n long, a long, b long"), "sets")
    rows = summary.filter("kind = 0").select(F.col("key").alias("doc_id"), "n", "a", "b")
    common = (
        summary.filter("kind = 1").groupBy("key").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "key").limit(FREQUENT).collect()
    )
    common.sort(key=lambda r: r["key"] % (1 << 64))
    frequent = spark.sparkContext.broadcast(np.array([r["key"] for r in common], np.int64).astype(np.uint64))
    counts = spark.sparkContext.broadcast(np.array([r["n"] for r in common], np.int64))

    # One row per distinct set, named by its least document.
    kinds = "a long, b long, doc_id long, n long, " + "".join(f"s{i} long, " for i in range(BITMAP)) + "wide binary, prefix array<long>"
    sets = docs.mapInArrow(_prefixes(k, percent, frequent, counts), kinds).groupBy("a", "b").agg(
        F.min("doc_id").alias("id"), F.first("n").alias("n"), *[F.first(f"s{i}").alias(f"s{i}") for i in range(BITMAP)],
        F.first("wide").alias("wide"), F.first("prefix").alias("prefix"))
    sets = cut(sets, "sets")
    names = sets.select("a", "b", "id")

    # Shingles that the prefixes of two sets share.
    entries = sets.select("id", F.posexplode("prefix").alias("pos", "h"))
    shared = entries.groupBy("h").agg(F.min("id").alias("lead"), F.max("id").alias("last")).filter("lead < last")
    entries = cut(entries.join(shared.select("h", "lead"), "h"), "entries")
    slim = sets.drop("prefix", "wide", "a", "b")
    bounded = _bounded("p", "q", percent)

    # First each set meets the set that leads most of its tiles. That joins large groups of near
    # copies by few pairs; pairs that it has joined need no more work.
    lead = entries.filter("id <> lead").groupBy("id", "lead").agg(F.count(F.lit(1)).alias("times"))
    lead = lead.groupBy("id").agg(F.max_by("lead", F.struct("times", -F.col("lead"))).alias("lead"))
    first = (
        lead.join(slim.alias("p"), "id").join(slim.select(F.col("id").alias("lead_id"), "n", *[f"s{i}" for i in range(BITMAP)]).alias("q"), F.col("lead") == F.col("lead_id"))
        .filter(bounded).select(F.col("lead").alias("x"), lead["id"].alias("y"))
    )
    links = _check(first, sets, docs, k, percent)
    groups = components(links, "x", "y")

    # Then all pairs of a tile that are not in one group yet.
    marked = entries.select("h", "id", "pos").join(groups, F.col("id") == F.col("node"), "left")
    marked = marked.select("h", "id", "pos", F.coalesce("component", "id").alias("g"))
    mixed = marked.groupBy("h").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).filter("lo < hi")
    marked = marked.join(mixed.select("h"), "h", "left_semi")
    # Two sets of one doc_id can't be told apart in a tile, so they carry nothing.
    marked = marked.join(sets.groupBy("id").agg(F.count(F.lit(1)).alias("twins")), "id")
    place = Window.partitionBy("id").orderBy("pos")
    last = [F.when(F.col("twins") == 1, F.lag("h", i + 1).over(place)).alias(f"b{i}") for i in range(BEFORE)]
    marked = cut(marked.select("h", "id", "pos", "g", *last), "marked")
    # A tile whose sets all come from one earlier tile has no first meeting.
    first = marked.groupBy("h").agg(F.min("b0").alias("lo"), F.max("b0").alias("hi"), F.count("b0").alias("from"), F.count(F.lit(1)).alias("rows"))
    first = first.filter("from < rows or lo <> hi").select("h")
    # Bitmaps join what is left only after those tiles, and those of a single group, are out.
    marked = marked.join(first, "h", "left_semi").join(slim, "id")
    step = float(Fraction(100, percent))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(step)) + F.lit(1e-9))
    marked = cut(marked.withColumn("band", band), "tiles")
    width = marked.groupBy("h", "band").agg(F.count(F.lit(1)).alias("rows"))
    split = F.ceil(F.col("rows") / TILE_ROWS).cast("int")
    left = marked.join(width.select("h", "band", split.alias("parts")), ["h", "band"])
    left = left.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    # A set is compared with its own band and the one below, in every part of those tiles.
    near = marked.select("*", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("tile"))
    near = near.join(width.select("h", F.col("band").alias("tile"), split.alias("parts")), ["h", "tile"])
    near = near.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    p, q = left.alias("p"), near.alias("q")
    met = p.join(q, F.expr(
        "p.h = q.h AND p.band = q.tile AND p.part = q.part AND p.g <> q.g "
        f"AND (p.n < q.n OR (p.n = q.n AND p.id < q.id)) AND {_placed('p', 'q', percent)} AND {bounded} AND NOT {_earlier('p', 'q')}"))
    pairs = cut(met.select(F.least("p.id", "q.id").alias("x"), F.greatest("p.id", "q.id").alias("y")).distinct(), "pairs")
    more = _check(pairs, sets, docs, k, percent)
    groups = cut(components(links.unionByName(more), "x", "y"), "groups")

    named = names.join(groups, F.col("id") == F.col("node"), "left").select("a", "b", F.coalesce("component", "id").alias("component_id"))
    found = rows.filter("n > 0").join(named, ["a", "b"], "left")
    out = found.unionByName(rows.filter("n = 0").withColumn("component_id", F.lit(None).cast("long")))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


#: Further texts of a repeated doc_id are named by numbers from here on.
FURTHER = 1 << 62


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with all its columns: of each group the document of the least doc_id.

    Rows that repeat a doc_id are documents of their own where their texts differ: the text of the
    least hash goes by the doc_id, the others rank behind all documents of other ids. Of rows that
    repeat a doc_id and its text one stays. Rows without doc_id, empty and null texts of an id of
    their own stay; an empty table gives no rows. doc_id has to be below 2^62.
    """
    name = "node"
    while name in docs.columns:
        name += "_"
    again = docs.groupBy("doc_id").count().filter("doc_id is not null and count > 1").select("doc_id")
    repeated = not again.isEmpty()
    node, text = F.col("doc_id").cast("long"), F.xxhash64("text")
    rows = docs.withColumn(name, node)
    if repeated:
        least = docs.join(again, "doc_id", "left_semi").groupBy(node.alias(name)).agg(F.min(text).alias("low"))
        further = F.xxhash64("doc_id", "text").bitwiseAND(F.lit(FURTHER - 1)).bitwiseOR(F.lit(FURTHER))
        own = least.select(F.col(name).alias("i"), F.col("low").alias("l"))
        pairs = rows.select(F.struct(*docs.columns).alias("row"), name, text.alias("t"), further.alias("f"))
        rows = pairs.join(own, F.col(name) == F.col("i"), "left").select("row.*", F.when(F.col("t") != F.col("l"), F.col("f")).otherwise(F.col(name)).alias(name))
    found = cut(ngram_groups(rows.select(name, "text"), k, percent, name).select("doc_id", "component_id"), "groups")
    gone = found.filter("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct()
    few = gone.count() <= BROADCAST_IDS
    kept = rows.join(F.broadcast(gone) if few else gone, name, "left_anti")
    if repeated:
        kept = kept.filter(F.col(name).isNotNull()).dropDuplicates([name]).unionByName(kept.filter(F.col(name).isNull()))
    return kept.select(*docs.columns)
