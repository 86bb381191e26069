"""Dictionary matching: which of any number of aliases a text holds, as substrings.

Aliases are taken in blocks whose automaton has CELLS entries at most, so what goes to tasks is bounded; each block is one map
over the texts, without a shuffle. Aliases and texts are compared as they are: callers fold their case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States times character classes of one automaton (four bytes each).
CELLS = 8_000_000


def blocks(aliases: DataFrame, cells: int = CELLS) -> Iterator[list[tuple[str, int]]]:
    """(alias, ord) in blocks: different aliases that aren't empty, each with its smallest ord, read a partition at a time."""
    held, letters, states = [], set(), 1
    each = aliases.filter("alias != ''").groupBy("alias").agg(F.min("ord").alias("ord"))
    for r in each.toLocalIterator():
        more = letters | set(r.alias)
        if held and (states + len(r.alias)) * (len(more) + 1) > cells:
            yield held
            held, more, states = [], set(r.alias), 1
        held.append((r.alias, r.ord))
        letters, states = more, states + len(r.alias)
    if held:
        yield held


def _automaton(spark, block: list[tuple[str, int]]):
    from ..functions import automaton as A

    order = sorted(range(len(block)), key=lambda i: (len(block[i][0]), -block[i][1]))
    ranks = [0] * len(block)
    for k, i in enumerate(order):
        ranks[i] = k + 1
    made = A.build([a for a, _ in block], ranks)
    return spark.sparkContext.broadcast((made, [(len(block[i][0]), block[i][1]) for i in order], [o for _, o in block], np.array([len(a) for a, _ in block], np.int64)))


def longest(texts: DataFrame, aliases: DataFrame, cells: int = CELLS) -> DataFrame:
    """texts(id, text) with ord, that of the longest of aliases(alias, ord) in the text, ties to the smaller ord; else null. Rows
    are kept as they are, those that share an id too."""
    from ..functions import automaton as A

    kind = texts.schema["id"].dataType.simpleString()
    df = texts.select("id", "text", F.lit(0).alias("n"), F.lit(None).cast("bigint").alias("ord"))
    for block in blocks(aliases, cells):
        shared = _automaton(texts.sparkSession, block)

        def run(batches, shared=shared):
            made, of, _, _ = shared.value
            for b in batches:
                best = A.best_of(made, [t or "" for t in b.column("text").to_pylist()])
                rows = []
                for r, n, o in zip(best.tolist(), b.column("n").to_pylist(), b.column("ord").to_pylist(), strict=True):
                    m, p = of[r - 1] if r else (0, None)
                    rows.append((m, p) if r and (m > n or (m == n and p < o)) else (n, o))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text"), pa.array([n for n, _ in rows], pa.int32()), pa.array([o for _, o in rows], pa.int64())], ["id", "text", "n", "ord"])

        df = df.mapInArrow(run, f"id {kind}, text string, n int, ord bigint")
    return df.select("id", "ord")


def mentions(texts: DataFrame, aliases: DataFrame, cells: int = CELLS, overlap: bool = True) -> DataFrame:
    """(id, ord, n): how often each text holds each alias, overlapping occurrences each, or from the left without overlap; a row a
    text and alias."""
    from ..functions import automaton as A

    kind, out = texts.schema["id"].dataType.simpleString(), None
    for block in blocks(aliases, cells):
        shared = _automaton(texts.sparkSession, block)

        def run(batches, shared=shared):
            made, _, ords, sizes = shared.value
            for b in batches:
                who, which, n = A.counts(made, [t or "" for t in b.column("text").to_pylist()], len(ords), None if overlap else sizes)
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(who)), pa.array([ords[i] for i in which.tolist()], pa.int64()), pa.array(n, pa.int64())], ["id", "ord", "n"])

        part = texts.select("id", "text").mapInArrow(run, f"id {kind}, ord bigint, n bigint")
        out = part if out is None else out.unionByName(part)
    return texts.select("id", F.lit(0).cast("bigint").alias("ord"), F.lit(0).cast("bigint").alias("n")).limit(0) if out is None else out
