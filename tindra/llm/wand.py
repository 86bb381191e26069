"""Ranked lexical search: an inverted index in shards, blocks of varying length, and exact block-skipping search.

Index. One pass over the texts, in place: a task turns its rows into shards of at most DOCS documents and POSTINGS postings, and
writes one row a (shard, term) with the postings in the order of doc_id, and one row a shard with its ids and counts. Where the
items ask for at most ASKED different terms, only their postings are made; with more, all are made and an equi-join picks those
asked for. N, L and df are counted from the rows.

Blocks. A posting's impact is what its term's weight is multiplied by. Dynamic programming cuts each list so that the sum over
blocks of (largest impact - impact), the bound's error, plus OPEN mean impacts for each block is least. Boundaries may lie after any posting
of lists up to GRID postings, and on a grid of GRID places of longer ones. Lists of a batch are cut side by side in matrices.

Search. A shard meets a block of items (at most about ITEMS, told apart by hash). Between two neighbouring block ends of an
item's terms no block changes, so WAND's bound has one value there: the sum of the largest contributions. Cells are taken
highest bound first, in growing batches; a cell whose bound is below the item's threshold (its tenth best score so far) is
skipped with all its postings. In a live cell the pivot is the first term, by ascending block maxima, at which their running sum
reaches the threshold: a document that holds none of the terms from the pivot on can't reach it, so only postings of those are
opened, and the rest are looked up for exact scores. Each shard gives an item its ten best at most, and a ranking within the
item, cut before the shuffle, gives the result.

Defined results: a null text, and one without a term, has none, and isn't one of the N. Rows are documents: repeated doc_ids and
repeated rows count each and may each be returned. A null doc_id is ranked after others of equal score. Rows that share an
item_id are one item, with the terms of all; items with a null item_id are left out; an item without terms, or whose terms
are in no document, has no rows. A term's score may be 0 (weights are floors); documents with score 0 aren't returned. Very long
texts are indexed whole. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, materialize, slices, small_batches

#: Bounds of a shard, of the terms sent to tasks, of a block of items, and of the places where a list may be cut.
DOCS, POSTINGS, ASKED, ITEMS, GRID = 8192, 1 << 20, 200_000, 512, 128
# Results an item; what a block costs, in mean impacts of its list.
TOP, OPEN = 10, 16.0
WIDEST = 64  # grid places in a block at most

#: Bytes: letters and digits of ASCII, A-Z lowered, and all bytes of other characters stay; the rest are blanks.
_TERMS = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of characters other than ASCII punctuation, blanks and controls, A-Z lowered. UTF-8 bytes of other
    characters are all over 0x7F, so bytes tell the same runs as characters."""
    return text.translate(_TERMS).split()


def asked_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term), each once."""

    def run(batches):
        for b in batches:
            for part in slices(b):
                ids, terms = [], []
                for i, t in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    found = set(terms_of(t or b""))
                    ids += [i] * len(found)
                    terms += found
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.binary()).cast(pa.string())], ["item", "term"])

    rows = small_batches(items.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("item"), F.col(text).alias("text")))
    return rows.mapInArrow(run, "item bigint, term string").distinct()


#: (shard, term, place, tf, n, ids): a posting's document by its place in the shard. term null: the shard's ids, and in tf and n its
#: documents and terms.
INDEX = "shard bigint, term string, place array<int>, tf array<bigint>, n array<bigint>, ids array<bigint>"


def postings(docs: DataFrame, only: list[str] | None = None, key: str = "doc_id", text: str = "text", most_docs: int = DOCS, most_postings: int = POSTINGS) -> DataFrame:
    """The index of docs, of the terms `only` if given."""
    wanted = None if only is None else {t.encode() for t in only}

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        ids: list = []
        lengths: list[int] = []
        lists: dict[bytes, tuple[list, list]] = {}
        size = total = 0

        def flush():
            nonlocal made, ids, lengths, lists, size, total
            shard = (task << 32) + made
            made += 1
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
            rank = np.empty(len(ids), np.int32)
            rank[order] = np.arange(len(ids))
            n = np.array(lengths, np.int64)
            cols: dict = {"shard": [shard], "term": [None], "place": [[]], "tf": [[len(ids)]], "n": [[total]], "ids": [[ids[i] for i in order]]}
            for k, (term, (at, tf)) in enumerate(lists.items()):
                at = np.array(at)
                place = rank[at]
                by = np.argsort(place)
                for c, v in zip(cols, (shard, term.decode(), place[by], np.array(tf, np.int64)[by], n[at][by], None), strict=True):
                    cols[c].append(v)
                if k % 4096 == 4095:
                    yield pa.RecordBatch.from_pydict(cols, SCHEMA)
                    cols = {c: [] for c in cols}
            if cols["shard"]:
                yield pa.RecordBatch.from_pydict(cols, SCHEMA)
            ids, lengths, lists, size, total = [], [], {}, 0, 0

        for b in batches:
            for part in slices(b):
                for i, t in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    found = terms_of(t or b"")
                    if not found:
                        continue
                    me = len(ids)
                    ids.append(i)
                    lengths.append(len(found))
                    total += len(found)
                    for term, tf in Counter(found if wanted is None else [x for x in found if x in wanted]).items():
                        if (at := lists.get(term)) is None:
                            at = lists[term] = ([], [])
                        at[0].append(me)
                        at[1].append(tf)
                        size += 1
                    if len(ids) >= most_docs or size >= most_postings:
                        yield from flush()
        if ids:
            yield from flush()

    rows = small_batches(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")))
    return rows.mapInArrow(run, INDEX)


SCHEMA = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("place", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64()))])


def cuts(impacts: list[np.ndarray], open_: float = OPEN, grid: int = GRID, widest: int = WIDEST) -> list[np.ndarray]:
    """Ends (exclusive) of each list's blocks: least sum of bound errors plus open_ mean impacts a block.

    The sum of impacts is the same however a list is cut, so a block costs its largest impact times its length, plus what it costs to open.
    Lists are laid into matrices of grid places; column by column, each place's least cost is taken over the places at most
    `widest` before it.
    """
    step = [max(1, -(-len(x) // grid)) for x in impacts]
    places = np.array([-(-len(x) // s) for x, s in zip(impacts, step, strict=True)])
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(impacts)
    order = np.argsort(places, kind="stable")
    for a in range(0, len(order), 512):
        group = order[a : a + 512]
        g = int(places[group].max(initial=0))
        if not g:
            continue
        top, upto = np.zeros((len(group), g)), np.zeros((len(group), g + 1))
        price = np.array([[open_ * (impacts[i].mean() if len(impacts[i]) else 0)] for i in group])
        for r, i in enumerate(group):
            starts = np.arange(0, len(impacts[i]), step[i])
            top[r, : places[i]] = np.maximum.reduceat(impacts[i], starts)
            upto[r, 1 : places[i] + 1] = np.minimum(starts + step[i], len(impacts[i]))
            upto[r, places[i] + 1 :] = len(impacts[i])
        best, back = np.zeros((len(group), g + 1)), np.zeros((len(group), g + 1), np.int32)
        for j in range(1, g + 1):
            lo = max(0, j - widest)
            most = np.maximum.accumulate(top[:, lo:j][:, ::-1], axis=1)[:, ::-1]  # the largest of places i..j-1
            cost = best[:, lo:j] + most * (upto[:, j : j + 1] - upto[:, lo:j]) + price
            pick = cost.argmin(axis=1)
            best[:, j], back[:, j] = cost[np.arange(len(group)), pick], lo + pick
        for r, i in enumerate(group):
            j, ends = int(places[i]), []
            while j:
                ends.append(int(upto[r, j]))
                j = back[r, j]
            out[i] = np.array(ends[::-1], np.int64)
    return out


BLOCKED = "shard bigint, term string, place array<int>, impact array<bigint>, ends array<int>, tops array<bigint>, ids array<bigint>"


def impact(tf, n, documents: int, terms: int):
    """(1000000000 tf) div (1000 tf + 8 m), m = 100 - 90 + (90 n N) div L."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * (10 + 90 * n * documents // terms))


def blocked(index: DataFrame, documents: int, terms: int) -> DataFrame:
    """The index's lists with impacts, and their blocks: ends (exclusive) and largest impacts."""

    def run(batches):
        for b in batches:
            lens = np.diff(b.column("tf").offsets.to_numpy())
            every = impact(b.column("tf").flatten().to_numpy(), b.column("n").flatten().to_numpy(), documents, terms)
            named = b.column("term").is_valid().to_numpy(zero_copy_only=False)
            xs = [x if ok else x[:0] for x, ok in zip(np.split(every, np.cumsum(lens)[:-1]) if len(lens) else [], named, strict=True)]
            ends = cuts(xs)
            tops = [np.maximum.reduceat(x, np.concatenate([[0], e[:-1]])) if len(e) else x for x, e in zip(xs, ends, strict=True)]
            cols = [pa.array(v, t) for v, t in ((xs, pa.list_(pa.int64())), (ends, pa.list_(pa.int32())), (tops, pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("term"), b.column("place"), *cols, b.column("ids")], ["shard", "term", "place", "impact", "ends", "tops", "ids"])

    return small_batches(index).mapInArrow(run, BLOCKED)


def best(lists: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], top: int = TOP, trace: Counter | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the `top` best documents over an item's lists (places, contributions, block ends, block maxima), best
    first, ties by place. trace counts postings, and those that were opened."""
    lasts = [p[e - 1] for p, _, e, _ in lists]  # each block's last place
    stops = np.unique(np.concatenate(lasts))  # cell c: places after stops[c - 1], up to stops[c]
    bound = np.zeros((len(lists), len(stops)), np.int64)
    for r, (last, (_, _, _, tops)) in enumerate(zip(lasts, lists, strict=True)):
        at = np.searchsorted(last, stops)
        bound[r, at < len(last)] = tops[at[at < len(last)]]
    whole = bound.sum(axis=0)
    order = np.argsort(-whole, kind="stable")
    edges = [np.concatenate([[0], np.searchsorted(p, stops, side="right")]) for p, _, _, _ in lists]  # postings of each cell
    places, scores, floor, done, width = np.zeros(0, np.int64), np.zeros(0, np.int64), 1, 0, 2
    while done < len(order):
        cells = order[done : done + width]
        done, width = done + len(cells), width * 2
        cells = cells[whole[cells] >= floor]
        if not len(cells):
            break  # bounds fall, so all others are too low as well
        b = bound[:, cells]
        rise = np.argsort(b, axis=0, kind="stable")
        pivot = np.cumsum(np.take_along_axis(b, rise, axis=0), axis=0) >= floor
        opened = np.zeros_like(pivot)
        np.put_along_axis(opened, rise, pivot, axis=0)
        found = []
        for r, (p, _, _, _) in enumerate(lists):
            mine = cells[opened[r]]
            lo, n = edges[r][mine], edges[r][mine + 1] - edges[r][mine]
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else lo, n) + np.arange(n.sum())
            found.append(p[at])
        docs = np.unique(np.concatenate(found))
        if trace is not None:
            trace["opened"] += sum(map(len, found))
            trace["documents"] += len(docs)
        s = np.zeros(len(docs), np.int64)
        for p, c, _, _ in lists:
            at = np.searchsorted(p, docs)
            at[at == len(p)] = 0
            hit = p[at] == docs
            s[hit] += c[at[hit]]
        places, scores = np.concatenate([places, docs]), np.concatenate([scores, s])
        keep = np.lexsort((places, -scores))[:top]
        keep = keep[scores[keep] > 0]
        places, scores = places[keep], scores[keep]
        if len(scores) == top:
            floor = max(1, int(scores[-1]))
    if trace is not None:
        trace["postings"] += sum(len(p) for p, _, _, _ in lists)
    return places, scores


FOUND = "item bigint, doc_id bigint, score bigint"


def search_shard(rows: pa.Table) -> pa.Table:
    """One shard's lists that a block of items asks for, with the items of each list: every item's best."""
    named = rows.column("term").is_valid()
    ids = rows.filter(pa.compute.invert(named)).column("ids").combine_chunks()
    out: dict = {"item": [], "doc_id": [], "score": []}
    lists = rows.filter(named).combine_chunks()
    if len(lists) and len(ids):
        names = ids[0].values
        array = lambda c, i: lists.column(c)[i].values.to_numpy()
        weight = lists.column("w").to_numpy()
        of: dict[int, list[int]] = {}
        for i, items in enumerate(lists.column("items").to_pylist()):
            for q in items:
                of.setdefault(q, []).append(i)
        ready = [(array("place", i), array("impact", i) * weight[i], array("ends", i), array("tops", i) * weight[i]) for i in range(len(lists))]
        for q, at in of.items():
            places, scores = best([ready[i] for i in at])
            out["item"] += [q] * len(places)
            out["doc_id"] += names.take(pa.array(places, pa.int64())).to_pylist()
            out["score"] += scores.tolist()
    return pa.table(out, pa.schema([(c, pa.int64()) for c in out]))


def rank(spark: SparkSession, docs: DataFrame, items: DataFrame, top: int = TOP, most_asked: int = ASKED, a_block: int = ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's best documents."""
    asked = materialize(spark, asked_terms(items), "asked")
    number = asked.agg(F.count_distinct("item").alias("items"), F.count_distinct("term").alias("terms")).first()
    only = [r.term for r in asked.select("term").distinct().collect()] if number.terms <= most_asked else None
    index = materialize(spark, postings(docs, only), "postings")
    seen = index.filter("term is null").agg(F.sum(F.col("tf")[0]).alias("N"), F.sum(F.col("n")[0]).alias("L")).first()
    if not seen.N or not number.items:
        drop(spark, asked, index)
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    df = index.filter("term is not null").groupBy("term").agg(F.sum(F.size("place")).alias("df"))
    ratio = F.lit(2.0 * seen.N + 2) / (2 * F.col("df") + 1)
    blocks = math.ceil(number.items / a_block)
    # a term's items within a block: about a_block at most
    groups = asked.groupBy("term", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list("item").alias("items"))
    groups = groups.join(df, "term").select("term", "block", "items", F.floor(1000 * F.log(ratio)).cast("bigint").alias("w"))
    made = index if only is not None else index.join(asked.select("term").distinct(), "term", "left_semi").unionByName(index.filter("term is null"))
    cut = materialize(spark, blocked(made, int(seen.N), int(seen.L)), "blocked")
    lists = cut.filter("term is not null").join(groups, "term")
    names = cut.filter("term is null").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns({"items": F.lit(None).cast("array<bigint>"), "w": F.lit(0).cast("bigint")})
    found = lists.unionByName(names).groupBy("shard", "block").applyInArrow(search_shard, FOUND)
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    out = materialize(spark, found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select(F.col("item").alias("item_id"), "rank", "doc_id", "score"), "ranked")
    drop(spark, asked, index, cut)
    return out


def oracle(top: int = TOP) -> str:
    """The same by scoring every document that holds a term of an item, as DuckDB SQL."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
s AS (SELECT count(*) AS N, sum(len(w))::BIGINT AS L FROM d WHERE len(w) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * N + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS wt FROM p, s GROUP BY term, N),
q AS (SELECT DISTINCT item_id, unnest({words}) AS term FROM benchmark WHERE item_id IS NOT NULL),
x AS (SELECT item_id, r, sum(wt * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(w) * N) // L))))::BIGINT AS score FROM q JOIN f USING (term) JOIN p USING (term) JOIN d USING (r), s GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score FROM x JOIN d USING (r) WHERE score > 0 QUALIFY rank <= {top}"""
