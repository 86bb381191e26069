"""Mixing sources to target weights: a min-cost flow over membership patterns, then seeded documents.

A document belongs to one source or to several. Documents are aggregated by their pattern (the set of their sources), which
leaves a row a pattern whatever their number. A pattern can be taken up to MOST times: its words are as many units of capacity
at each of the COSTS, which rise, so a first taking comes before a second anywhere. The flow routes words from patterns to the
quotas of their sources: as many as fit, at the least cost. Sources that no pattern ties together don't concern each other, so
the flow is solved for each connected component of sources, a task a component; its rows are patterns, not documents.

Of a pattern that gives `drawn` words, each document is taken drawn div words times, and documents in seeded order once more
as long as they fit in the rest: sums over one written range sort, in which no pattern meets in one task. What is left open,
less than the next document's size, is closed by the document whose size comes nearest to it, CLOSING times at most and only
where that brings the pattern nearer. Whole documents are taken, so a pattern is off by less than its smallest document that
isn't taken, if even that.

Targets: a source has its weight's share of all words, up to MOST times its own words; what is over is dealt to the others by
weight, until none is above.

Defined results: words are runs of characters that aren't blanks of ASCII; a null, empty or blank text has none and is taken 0
times. A null source is a source like others, the last. Repeated rows are documents each; which of equal rows is taken doesn't
show in the result. A document without any source is never taken. Documents are ordered by the MD5 of `seed:doc_id`, then by
doc_id (null last) and size, so reruns agree. Very long texts are counted whole. An empty table gives no rows.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import numbered, running
from .common import materialize
from .components import connected_components

# Times that a document may be taken, the cost of a word's first, second and third taking, the weights by the
# source's place, and the seed.
MOST, COSTS, WEIGHTS, SEED = 3, (0, 1, 3), (1, 2, 3), 11
CLOSING = 4
WORD = r"[^\x20\x09-\x0D]+"


def min_cost_flow(supply: list[int], reach: list[list[int]], quota: list[int], costs: tuple[int, ...] = COSTS) -> list[dict[int, int]]:
    """Words that each pattern gives to each quota: the largest flow, of those the cheapest. supply: a pattern's words at each
    level; reach: the quotas that it may serve. Shortest augmenting paths over the residual graph; ties by position."""
    p, q = len(supply), len(quota)
    start, end = p + q, p + q + 1
    to, room, price, arcs = [], [], [], [[] for _ in range(p + q + 2)]

    def arc(a: int, b: int, capacity: int, cost: int) -> None:
        arcs[a].append(len(to))
        arcs[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((capacity, 0))
        price.extend((cost, -cost))

    total = sum(quota)
    for i, n in enumerate(supply):
        for c in costs:
            arc(start, i, n, c)
    ties = {}
    for i, js in enumerate(reach):
        for j in js:
            ties[i, j] = len(to)
            arc(i, p + j, total, 0)
    for j, n in enumerate(quota):
        arc(p + j, end, n, 0)
    while True:
        dist: list = [None] * (p + q + 2)
        dist[start], via, queue, waiting = 0, [-1] * (p + q + 2), deque([start]), {start}
        while queue:
            a = queue.popleft()
            waiting.discard(a)
            for e in arcs[a]:
                b = to[e]
                if room[e] and (dist[b] is None or dist[a] + price[e] < dist[b]):
                    dist[b], via[b] = dist[a] + price[e], e
                    if b not in waiting:
                        waiting.add(b)
                        queue.append(b)
        if dist[end] is None:
            break
        path, at = [], end
        while at != start:
            path.append(via[at])
            at = to[via[at] ^ 1]
        least = min(room[e] for e in path)
        for e in path:
            room[e] -= least
            room[e ^ 1] += least
    return [{j: room[ties[i, j] ^ 1] for j in js if room[ties[i, j] ^ 1]} for i, js in enumerate(reach)]


def sized(docs: DataFrame, members: Column, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(uid, doc_id, pattern, size, h): a document's sources as JSON, its words, and its place in the seeded order."""
    id_ = F.col(key).cast("long")
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null"))))
    return docs.select(F.monotonically_increasing_id().alias("uid"), id_.alias("doc_id"), F.to_json(F.array_sort(F.array_distinct(members))).alias("pattern"), words.alias("size"), h.alias("h"))


def source_targets(patterns: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(place, source, size, target) of each source over patterns(pattern, words); places from 1 by code point, null last. A
    round is one sum over the sources; the last one caps nothing more."""
    spark = patterns.sparkSession
    each = patterns.select("words", F.explode(F.from_json("pattern", "array<string>")).alias("source")).groupBy("source").agg(F.sum("words").alias("size"))
    listed = numbered(each, F.col("source").asc_nulls_last(), name="place")
    weight = F.array(*map(F.lit, weights))[((F.col("place") - 1) % len(weights)).cast("int")]
    listed = materialize(spark, listed.withColumn("weight", weight).withColumn("cap", most * F.col("size")), "sources")
    total = patterns.filter("pattern != '[]'").agg(F.sum("words")).first()[0] or 0
    share, capped = 0.0, None
    while True:
        over = F.col("weight") * F.lit(share) > F.col("cap")
        s = listed.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("cap")).otherwise(0)).alias("held"), F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("open")).first()
        if s.n == capped or not s.open:
            break
        capped, share = s.n, (total - s.held) / s.open
    return listed.select("place", "source", "size", F.least(F.col("weight") * F.lit(share), F.col("cap").cast("double")).alias("target"))


def flows(spark: SparkSession, patterns: DataFrame, sources: DataFrame, costs: tuple[int, ...] = COSTS) -> DataFrame:
    """(pattern, words, place, drawn): the words that each pattern gives to each of its sources, 0 among them."""
    ends = patterns.select("pattern", "words", F.explode(F.from_json("pattern", "array<string>")).alias("s"))
    ends = ends.join(sources.select("place", F.col("source").alias("t"), F.round("target").cast("long").alias("quota")), F.col("s").eqNullSafe(F.col("t"))).drop("s", "t")
    ends = materialize(spark, ends, "ends")
    first = ends.groupBy("pattern").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    ties = ends.join(first.filter("n > 1"), "pattern").filter("place != first").select("first", "place")
    if ties.isEmpty():
        tied = ends.withColumn("component", F.col("place"))
    else:
        parts = materialize(spark, connected_components(spark, ties), "parts")
        tied = ends.join(parts, F.col("place") == F.col("id"), "left").withColumn("component", F.coalesce("component", "place")).drop("id")

    def solve(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: (r["pattern"], r["place"]))
        names, places = sorted({r["pattern"] for r in rows}), sorted({r["place"] for r in rows})
        at, spot = {x: i for i, x in enumerate(names)}, {x: j for j, x in enumerate(places)}
        supply, quota, reach = [0] * len(names), [0] * len(places), [[] for _ in names]
        for r in rows:
            supply[at[r["pattern"]]], quota[spot[r["place"]]] = r["words"], r["quota"]
            reach[at[r["pattern"]]].append(spot[r["place"]])
        drawn = min_cost_flow(supply, reach, quota, costs)
        return pa.table({"pattern": [r["pattern"] for r in rows], "words": pa.array([r["words"] for r in rows], pa.int64()), "place": pa.array([r["place"] for r in rows], pa.int64()), "drawn": pa.array([drawn[at[r["pattern"]]].get(spot[r["place"]], 0) for r in rows], pa.int64())})

    return tied.select("component", "pattern", "words", "place", "quota").groupBy("component").applyInArrow(solve, "pattern string, words bigint, place bigint, drawn bigint")


def select(spark: SparkSession, rows: DataFrame, plan: DataFrame, closing: int = CLOSING) -> DataFrame:
    """rows(uid, doc_id, pattern, size, h) with taken, under plan(pattern, level, rest)."""
    known = rows.join(plan, "pattern", "left")
    part = F.coalesce(F.col("rest") * F.sign("size"), F.lit(0)) > 0  # documents of which some are taken once more
    order = ["h", F.col("doc_id").asc_nulls_last(), "size", "uid"]
    dealt = materialize(spark, running(known.filter(part), "pattern", "size", *order).withColumn("once", F.col("upto") + F.col("size") <= F.col("rest")).drop("upto"), "dealt")
    gaps = dealt.groupBy("pattern").agg((F.first("rest") - F.sum(F.when(F.col("once"), F.col("size")).otherwise(0))).alias("gap"))
    gaps, picks = materialize(spark, gaps.filter("gap > 0"), "gaps"), None
    for _ in range(closing):
        left = dealt.filter("not once").join(gaps, "pattern")
        if picks is not None:
            left = left.join(picks.select("uid"), "uid", "left_anti")
        off = F.abs(F.col("gap") - F.col("size"))
        near = left.filter(off < F.col("gap")).groupBy("pattern").agg(F.min(F.struct(off.alias("off"), "h", F.col("doc_id").isNull().alias("nameless"), "doc_id", "size", "uid", "gap")).alias("b"))
        new = materialize(spark, near.select("pattern", "b.uid", (F.col("b.gap") - F.col("b.size")).alias("gap")), "picks")
        if new.isEmpty():
            break
        picks = new.select("uid") if picks is None else picks.unionByName(new.select("uid"))
        gaps = new.filter("gap > 0").select("pattern", "gap")
    if picks is not None:
        dealt = dealt.join(picks.withColumn("_picked", F.lit(True)), "uid", "left").withColumn("once", F.col("once") | F.coalesce("_picked", F.lit(False))).drop("_picked")
    rest = known.filter(~part).withColumn("once", F.lit(False))
    out = rest.unionByName(dealt.select(rest.columns))
    return out.withColumn("taken", (F.coalesce("level", F.lit(0)) + F.col("once").cast("int")) * F.col("size")).select("doc_id", "pattern", "size", "taken")


def mix(spark: SparkSession, docs: DataFrame, members: Column, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, key: str = "doc_id", text: str = "text") -> dict[str, DataFrame]:
    """documents(doc_id, pattern, size, taken), sources(place, source, size, target) and flows(pattern, words, place, drawn).
    members: the array of a document's sources."""
    rows = materialize(spark, sized(docs, members, seed, key, text), "sizes")
    patterns = materialize(spark, rows.groupBy("pattern").agg(F.sum("size").alias("words")), "patterns")
    sources = materialize(spark, source_targets(patterns, weights), "targets")
    routed = materialize(spark, flows(spark, patterns, sources), "flows")
    drawn = routed.groupBy("pattern", "words").agg(F.sum("drawn").alias("drawn")).filter("words > 0")
    plan = materialize(spark, drawn.select("pattern", F.expr("drawn div words").alias("level"), F.expr("drawn % words").alias("rest")), "plan")
    return {"documents": select(spark, rows, plan), "sources": sources, "flows": routed}


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of documents with one source each."""
    got = mix(spark, docs, F.array("source"))
    of = got["sources"].select(F.to_json(F.array("source")).alias("pattern"), F.col("size").alias("source_size"), "target")
    return got["documents"].join(of, "pattern").select("doc_id", "size", "source_size", "target", "taken")


def oracle(weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED, closing: int = CLOSING, rounds: int = 12) -> str:
    """The same as DuckDB SQL. With one source each the flow has a closed form: a source's documents, level by level. Rounds
    that cap nothing more change nothing."""
    lams = ["l0 AS (SELECT sum(size) / sum(w) AS lam FROM s)"]
    lams += [f"l{i} AS (SELECT ((SELECT sum(size) FROM s) - coalesce(sum(cap) FILTER (WHERE w * lam > cap), 0)) / sum(w) FILTER (WHERE NOT w * lam > cap) AS lam FROM s, l{i - 1})" for i in range(1, rounds)]
    steps = ["g0 AS (SELECT k, rest - coalesce(sum(size) FILTER (WHERE once), 0) AS gap FROM d0 GROUP BY k, rest)"]
    for i in range(1, closing + 1):
        taken = "".join(f" AND u NOT IN (SELECT u FROM b{j})" for j in range(1, i))
        steps.append(f"b{i} AS (SELECT k, arg_min(u, (abs(gap - size), h, doc_id IS NULL, doc_id, size, u)) AS u, arg_min(gap - size, (abs(gap - size), h, doc_id IS NULL, doc_id, size, u)) AS gap FROM d0 JOIN g{i - 1} USING (k) WHERE NOT once AND abs(gap - size) < gap{taken} GROUP BY k)")
        steps.append(f"g{i} AS (SELECT k, gap FROM b{i} WHERE gap > 0)")
    picked = " UNION ALL ".join(f"SELECT u FROM b{i}" for i in range(1, closing + 1))
    return f"""
WITH x AS (SELECT row_number() OVER () AS u, doc_id, coalesce(source, '\x01null') AS k, md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null')) AS h, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT k, size, {most} * size AS cap, [{', '.join(map(str, weights))}][(row_number() OVER (ORDER BY k = '\x01null', k) - 1) % {len(weights)} + 1] AS w FROM (SELECT k, sum(size)::BIGINT AS size FROM x GROUP BY k)),
{', '.join(lams)},
t AS (SELECT k, s.size AS source_size, least(w * lam, cap::DOUBLE) AS target, round(least(w * lam, cap::DOUBLE))::BIGINT AS quota FROM s, l{rounds - 1}),
y AS (SELECT x.*, source_size, target, quota // nullif(source_size, 0) AS level, quota % nullif(source_size, 0) AS rest FROM x JOIN t USING (k)),
d0 AS (SELECT *, sum(size) OVER (PARTITION BY k ORDER BY h, doc_id NULLS LAST, size, u ROWS UNBOUNDED PRECEDING) <= rest AS once FROM y WHERE size > 0 AND rest > 0),
{', '.join(steps)},
p AS ({picked})
SELECT doc_id, size, source_size, target, ((coalesce(level, 0) + CASE WHEN u IN (SELECT u FROM p) OR u IN (SELECT u FROM d0 WHERE once) THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM y"""
