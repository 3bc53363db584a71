"""Best-fit packing of texts into sequences of several permitted lengths.

Texts are measured in words. One longer than the greatest permitted length is dealt in pieces
of that length. Pieces are dealt to shards of about equal volume, and every shard is packed by
itself: best fit over open bins, a new bin of the least cost per expected word, and at the end
every bin downsized to the least length that holds its contents. Of several opening rules the
one that makes the shard cheapest is taken.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Permitted lengths, what a sequence costs beside its length, and words of one shard.
LENGTHS, OVERHEAD, SHARD_WORDS = (512, 1024, 2048, 4096), 16, 4_000_000


def _fit(sizes: Sequence[int], lengths: Sequence[int], opens) -> tuple[list[int], list[int]]:
    """(bin of each size, fill of each bin); ``opens(size, left)`` gives the length of a new bin."""
    room: dict[int, list[int]] = {}
    rooms: list[int] = []
    fill: list[int] = []
    where: list[int] = []
    left = sum(sizes)
    for size in sizes:
        at = bisect_left(rooms, size)
        if at < len(rooms):
            r = rooms[at]
            b = room[r].pop()
            if not room[r]:
                del room[r]
                rooms.pop(at)
        else:
            r, b = opens(size, left), len(fill)
            fill.append(0)
        fill[b] += size
        where.append(b)
        if r > size:
            if r - size not in room:
                room[r - size] = []
                insort(rooms, r - size)
            room[r - size].append(b)
        left -= size
    return where, fill


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, overhead: int = OVERHEAD) -> tuple[list[int], list[int]]:
    """(bin of each size, length of each bin). Sizes are from 1 to the greatest length, largest first."""
    lengths = sorted(lengths)

    def cheapest(size: int, left: int) -> int:
        return min((c for c in lengths if c >= size), key=lambda c: ((c + overhead) / min(c, max(left, size)), -c))

    rules = [cheapest, *[(lambda size, left, c=c: next(x for x in lengths if x >= max(size, c))) for c in lengths]]
    best = None
    for rule in rules:
        where, fill = _fit(sizes, lengths, rule)
        caps = [lengths[bisect_left(lengths, f)] for f in fill]
        cost = sum(caps) + overhead * len(caps)
        if best is None or cost < best[0]:
            best = (cost, where, caps)
    return best[1], best[2]


def _pack_shard(lengths: Sequence[int], overhead: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "rid", "start"], ascending=[False, True, True], kind="stable")
        where, caps = pack(rows["length"].tolist(), lengths, overhead)
        rows["bin_id"] = rows["shard"].to_numpy(np.int64) * (1 << 32) + np.array(where, np.int64)
        rows["capacity"] = np.array(caps, np.int64)[where] if len(rows) else np.zeros(0, np.int64)
        rows["bin_offset"] = rows.groupby("bin_id")["length"].cumsum() - rows["length"]
        return rows[["doc_id", "start", "length", "bin_id", "capacity", "bin_offset"]]

    return run


def word_count(text: str = "text") -> F.Column:
    """Runs of other characters than ASCII white space; 0 for null."""
    flat = F.translate(F.col(text).cast("string"), "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.array_remove(F.split(flat, " "), "")), F.lit(0)).cast("bigint")


def pack_documents(docs: DataFrame, lengths: Sequence[int] = LENGTHS, overhead: int = OVERHEAD, shard_words: int = SHARD_WORDS,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, bin_id, capacity, bin_offset): where every piece of every text lies.

    ``start`` and ``length`` are word numbers of the piece in its text, ``bin_offset`` its first
    word in the sequence ``bin_id`` of ``capacity`` words. Pieces of one bin do not overlap, and
    the bin is the least permitted length that holds them.

    A null or empty text has no words and so no piece. Rows that repeat, also with a null doc_id,
    are packed each for itself. An empty table gives no rows; other columns are not read.
    """
    if not lengths or min(lengths) < 1:
        raise ValueError("permitted lengths must be positive")
    most = max(lengths)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", word_count().alias("n"), F.monotonically_increasing_id().alias("rid"))
    # Written once, so that the row numbers stay what they are when a task runs again.
    rows = cut(rows.filter("n > 0"), "lengths")
    total = rows.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    pieces = rows.select("rid", "doc_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(most).cast("bigint"))).alias("start"))
    pieces = pieces.select(
        "rid", "doc_id", "start", F.least(F.lit(most), F.col("n") - F.col("start")).cast("bigint").alias("length"),
        F.pmod(F.xxhash64("rid", "start"), F.lit(shards)).cast("bigint").alias("shard"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, bin_id long, capacity long, bin_offset long"
    return pieces.groupBy("shard").applyInPandas(_pack_shard(tuple(lengths), overhead), schema)
