"""Best-fit packing into sequences of several permitted lengths.

Pieces of one length are interchangeable, so the best fit is computed on the histogram of lengths, which has as many rows as
the largest capacity has tokens, whatever the number of documents. Lengths go in descending order; a piece joins the open
bin with the least room that still holds it, of equal ones that which holds most. Where none does, a bin is opened at the capacity of least cost: each permitted
size is filled on trial from the lengths that remain, and the one with the least cost per content token wins, for all bins that
what is left of the length needs. A sequence of c
tokens costs OVERHEAD + c + c * c / SPAN: a fixed part, a part by the token and attention. At last each bin is downsized to the
smallest permitted size that holds its contents. The plan is a list of ranges (length, first rank, first bin), some thousands
of rows; documents find their bins by their rank among equal lengths, which comes from ranks within partitions and the
partitions' offsets, dealt by partition. No group of equal lengths meets in one task.

Tokens are runs of at most UNIT characters other than white space, so that a huge word has its weight; or, where lengths are
measured by a tokenizer, its tokens (`measured`). Texts over the largest capacity are split into pieces; none is cut off.

Defined results: a null, empty or blank text has one row of 0 tokens in no bin (null bin). Ties: equal lengths are placed in
the order of partition and row. Repeated rows are packed each on their own. Very long texts and words become many pieces. An
empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

# Permitted sequence lengths, what a sequence costs besides its tokens, and the length at which attention costs
# as much as everything else.
CAPACITIES, OVERHEAD, SPAN = (512, 1024, 2048, 4096, 8192), 16, 16_384
UNIT = 8


def cost(size: int, overhead: int = OVERHEAD, span: int = SPAN) -> float:
    return overhead + size + size * size / span


def _trial(space: int, lengths: list[int], counts: dict[int, int], used: int) -> int:
    """Tokens that a greedy fill of the space would place; used: how many of the largest length are spoken for."""
    filled, top = 0, len(lengths)
    while space and (i := bisect_right(lengths, space, 0, top)):
        n = lengths[i - 1]
        have = counts[n] - (used if i == len(lengths) else 0)
        take = min(max(have, 0), space // n)
        filled, space, top = filled + take * n, space - take * n, i - 1
    return filled


def best_fit(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, span: int = SPAN) -> tuple[list[tuple[int, int, int, int, int, int]], list[tuple[int, int, int, int]]]:
    """histogram: length -> pieces. Returns placements (length, first rank, pieces, first bin, offset, pieces a bin) and bins
    (first bin, bins, tokens in each, capacity). All bins of a range are alike."""
    caps = sorted(capacities)
    lengths = sorted(n for n, k in histogram.items() if k > 0)
    if lengths and (lengths[0] < 1 or lengths[-1] > caps[-1]):
        raise ValueError("a piece must have a token and fit the largest capacity")
    counts, placed, closed, bins = dict(histogram), [], [], 0
    rooms: list[int] = []
    open_: dict[int, list[tuple[int, int, int]]] = {}  # room -> (first bin, bins, tokens so far)

    def put(room: int, first: int, n: int, used: int) -> None:
        if room < lengths_min:
            closed.append((first, n, used))
        else:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((first, n, used))

    lengths_min = lengths[0] if lengths else 0
    while lengths:
        n = lengths[-1]
        rank, left = 0, counts[n]
        while left:
            i = bisect_left(rooms, n)
            if i == len(rooms):
                counts[n] = left
                _, _, size = min((cost(c, overhead, span) / (n + _trial(c - n, lengths, counts, 1)), -c, c) for c in caps if c >= n)
                new = -(-left // (size // n))
                put(size, bins, new, 0)
                bins += new
                continue
            room = rooms[i]
            first, have, used = open_[room].pop(max(range(len(open_[room])), key=lambda k: open_[room][k][2]))
            if not open_[room]:
                del open_[room]
                rooms.pop(i)
            # what is left of the room is the least one that still holds the length, so a bin takes as many as fit
            each = room // n
            whole = min(have, left // each)
            if whole:
                placed.append((n, rank, whole * each, first, used, each))
                put(room - each * n, first, whole, used + each * n)
            rank, left = rank + whole * each, left - whole * each
            if whole < have and left and left < each:
                placed.append((n, rank, left, first + whole, used, left))
                put(room - left * n, first + whole, 1, used + left * n)
                rank, left, whole = rank + left, 0, whole + 1
            if whole < have:
                put(room, first + whole, have - whole, used)
        lengths.pop()
    closed += [x for group in open_.values() for x in group]
    return placed, [(first, n, used, next(c for c in caps if c >= used)) for first, n, used in sorted(closed) if used]


def pieces(df: DataFrame, largest: int, key: str = "doc_id", text: str = "text", measured: str | None = None) -> DataFrame:
    """(key, piece, first_token, n_tokens): consecutive pieces of each whole text. measured: a column of lengths, else tokens are
    counted in the text."""
    units = F.regexp_count(F.coalesce(df[text], F.lit("")), F.lit(rf"\S{{1,{UNIT}}}")) if measured is None else F.coalesce(df[measured], F.lit(0))
    n = df.select(F.col(key), units.cast("int").alias("n"))
    cut = n.select(key, "n", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n") - 1) / largest)).cast("int"))).alias("piece"))
    return cut.select(key, "piece", (F.col("piece") * largest).alias("first_token"), F.least(F.lit(largest), F.col("n") - F.col("piece") * largest).alias("n_tokens"))


def _ranked(batches):
    """Adds each piece's rank among the equal lengths of its partition."""
    from pyspark import TaskContext

    part, seen = TaskContext.get().partitionId(), np.zeros(0, np.int64)
    for b in batches:
        n = b.column("n_tokens").to_numpy()
        if len(n) and n.max() >= len(seen):
            seen = np.pad(seen, (0, int(n.max()) + 1 - len(seen)))
        order = np.argsort(n, kind="stable")
        s = n[order]
        start = np.searchsorted(s, s, side="left")
        rank = np.empty(len(n), np.int64)
        rank[order] = np.arange(len(n)) - start + seen[s]
        np.add.at(seen, n, 1)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(rank)], [*b.schema.names, "part", "rank"])


def pack(spark: SparkSession, df: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, key: str = "doc_id", text: str = "text", measured: str | None = None, span: int = SPAN) -> DataFrame:
    """(key, piece, first_token, n_tokens, bin_id, bin_capacity, bin_offset) for every piece of every document."""
    kind = df.schema[key].dataType.simpleString()
    cut = pieces(df, max(capacities), key, text, measured)
    own = materialize(spark, cut.mapInArrow(_ranked, f"`{key}` {kind}, piece int, first_token int, n_tokens int, part int, rank long"), "pieces")
    by_part = materialize(spark, own.filter("n_tokens > 0").groupBy("n_tokens", "part").agg(F.count(F.lit(1)).alias("k")), "lengths")
    histogram = {r.n_tokens: r.k for r in by_part.groupBy("n_tokens").agg(F.sum("k").alias("k")).collect()}  # one row a length
    placed, bins = best_fit(histogram, tuple(capacities), overhead, span)
    placed.sort()
    p = np.array(placed, np.int64).reshape(-1, 6)
    q = np.array(bins, np.int64).reshape(-1, 4)
    wide, most = np.int64(2**40), max(capacities)
    names = [key, "piece", "first_token", "n_tokens", "bin_id", "bin_capacity", "bin_offset"]

    def assign(rows: pa.Table, offsets: pa.Table) -> pa.Table:
        """One partition's pieces with how many of each length the partitions before it hold."""
        before = np.zeros(most + 1, np.int64)
        before[offsets.column("n_tokens").to_numpy()] = offsets.column("before").to_numpy()
        n = rows.column("n_tokens").to_numpy().astype(np.int64)
        r = rows.column("rank").to_numpy() + before[n]
        room = n > 0
        if len(p):
            i = np.where(room, np.searchsorted(p[:, 0] * wide + p[:, 1], n * wide + r, side="right") - 1, 0)
            at = r - p[i, 1]
            to, offset = p[i, 3] + at // p[i, 5], p[i, 4] + at % p[i, 5] * n
            cap = q[np.maximum(np.searchsorted(q[:, 0], to, side="right") - 1, 0), 3]
        else:
            to = offset = cap = np.zeros(len(n), np.int64)
        out = [pa.array(x, t, mask=~room) for x, t in ((to, pa.int64()), (cap.astype(np.int32), pa.int32()), (offset.astype(np.int32), pa.int32()))]
        return pa.table([*[rows.column(c) for c in names[:4]], *out], names)

    before = F.sum("k").over(Window.partitionBy("n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = by_part.select("n_tokens", "part", F.coalesce(before, F.lit(0)).alias("before"))
    return own.groupBy("part").cogroup(offsets.groupBy("part")).applyInArrow(assign, f"`{key}` {kind}, piece int, first_token int, n_tokens int, bin_id long, bin_capacity int, bin_offset int")
