"""Pairs within hot groups, random pairs, components, bounds and the dedupe built on them, against plain versions."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tindra.functions.python import jaro_winkler
from tindra.operators import components, entities, pairs

from .test_operators import rows


def test_pairs_within(spark):
    data = [("hot", i) for i in range(230)] + [("few", i) for i in (3, 1, 2, 2)] + [("one", 9), (None, 1), ("null", None), ("two", 5), ("two", 4)]
    df = spark.createDataFrame(data, "k string, x int").repartition(3)
    groups = {}
    for k, x in data:
        if k is not None and x is not None:
            groups.setdefault(k, set()).add(x)
    want = sorted(((k, a, b) for k, xs in groups.items() for a, b in combinations(sorted(xs), 2)), key=str)
    for most in (10, 64, 2048):
        assert rows(pairs.within(df, "k", "x", most)) == want


def test_no_cell_is_large(spark):
    """A group of 50,000 is dealt into blocks of about 2,048; equi-joins only; and no pair is lost or made twice."""
    dealt = spark.range(50_000).select(F.pmod(F.xxhash64("id"), F.lit(25)).alias("s")).groupBy("s").count()
    assert dealt.agg(F.max("count")).first()[0] < 1.2 * 2048
    df = spark.range(5000).select(F.pmod("id", F.lit(1)).alias("k"), F.col("id").alias("x"))
    plan = pairs.within(df, "k", "x", 256)
    assert "CartesianProduct" not in (text := plan._jdf.queryExecution().toString()) and "NestedLoop" not in text
    assert plan.agg(F.count(F.lit(1)), F.sum("a"), F.sum("b")).first() == (5000 * 4999 // 2, sum(i * (4999 - i) for i in range(5000)), sum(i * i for i in range(5000)))


def test_random_pairs(spark):
    df = spark.createDataFrame([(i * 3,) for i in range(60)], "x long")
    assert rows(pairs.sampled(df, "x")) == sorted(combinations(range(0, 180, 3), 2), key=str)
    some = pairs.sampled(df, "x", 500).collect()
    assert len(some) == 500 and len(set(some)) > 450 and all(r.a < r.b for r in some)
    # every place is drawn about alike: 500 pairs have 1,000 ends over 60 places
    ends = Counter(x for r in some for x in (r.a, r.b))
    assert len(ends) == 60 and max(ends.values()) < 2.2 * 1000 / 60
    assert pairs.sampled(df.limit(1), "x").count() == 0 and pairs.sampled(df.limit(0), "x").count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("s", f"t{i}") for i in range(60)] + [(f"r{rng.randint(0, 60)}", f"r{rng.randint(0, 60)}") for _ in range(40)] + [("self", "self")]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = components.connected(spark.createDataFrame([*edges, (None, "s")], "src string, dst string"))
    assert {r.id: r.component for r in got.collect()} == {x: find(x) for x in up}


def names(n=160):
    rng = random.Random(7)
    return ["", "a", "anna", "anna maria", "áéíó", "ann", "日本"] + ["".join(rng.choices("abcdeé ", k=rng.randint(1, 12))) for _ in range(n)]


def test_bound_is_a_bound(spark):
    df = spark.createDataFrame(list(enumerate(names())), "id int, n string").withColumn("l", entities.letters("n"))
    both = df.selectExpr("n as a", "l as la").crossJoin(df.selectExpr("n as b", "l as lb"))
    got = both.select("a", "b", entities.jaro_winkler_bound("a", "b", "la", "lb").alias("u")).collect()
    assert all(r.u >= jaro_winkler(r.a, r.b) for r in got)
    assert sum(r.u < 0.85 for r in got) > 0.5 * len(got)  # and it spares most pairs the way to Python


def test_compare_without_exact_has_the_same_levels(spark):
    e = spark.createDataFrame(list(enumerate(names(60))), "id int, name_fold string")
    w = spark.createDataFrame([(i, i % 9) for i in range(60)], "id int, work int")
    p = pairs.sampled(e, "id")
    cols = ("a", "b", "shared", "name_level", "work_level")
    assert rows(entities.compare(p, e, w), *cols) == rows(entities.compare(p, e, w, exact=False), *cols)


def plain_em(counts, u, first, prior=2e-4, rounds=25):
    m, lam = list(first), prior
    for _ in range(rounds):
        p = [lam * m[k] / (lam * m[k] + (1 - lam) * u[k]) for k in range(3)]
        found = sum(c * q for c, q in zip(counts, p, strict=True))
        lam = min(max(found / sum(counts), 1e-9), 0.5)
        m = [(c * q + 1e-3) / (found + 3e-3) for c, q in zip(counts, p, strict=True)]
    return m


def test_dedupe(spark):
    """Slips of a name with common works are found and clustered; namesakes without a common work and strangers aren't."""
    rng = random.Random(3)
    base = ["".join(rng.choices("bcdfghjklmnprst", k=9)) for _ in range(80)]
    people = list(enumerate(base)) + [(100 + i, base[i] + "s") for i in range(10)] + [(200 + i, base[i] + "x") for i in range(3)] + [(300, base[20][:4] + "zzzzz")]
    works = [(i, 10 * i + k) for i in range(80) for k in range(3)] + [(100 + i, 10 * i + k) for i in range(10) for k in range(2)] + [(200 + i, 10 * i + k) for i in range(3) for k in range(3)] + [(300, 5000)]
    e, w = spark.createDataFrame(people, "id int, name_fold string"), spark.createDataFrame(works, "id int, work int")
    got = {(r.a, r.b): (r.score, r.cluster) for r in entities.dedupe(e, w, most=16).collect()}
    assert set(got) == {(i, 100 + i) for i in range(10)} | {(i, 200 + i) for i in range(3)} | {(100 + i, 200 + i) for i in range(3)}
    assert all(c == a % 100 for (a, _), (_, c) in got.items())
    # the numbers, by loops over all pairs
    name, of = dict(people), {}
    for i, k in works:
        of.setdefault(i, set()).add(k)
    level = lambda a, b: ((j := jaro_winkler(name[a], name[b])) >= 0.85) + (j >= 0.92)
    common = lambda a, b: min(2, len(of[a] & of[b]))
    every = list(combinations(sorted(name), 2))
    u = [[(sum(f(*p) == k for p in every) + 1) / (len(every) + 3) for k in range(3)] for f in (level, common)]
    m = plain_em([sum(common(*p) == 2 and level(*p) == k for p in every) for k in range(3)], u[0], (0.05, 0.15, 0.8)), plain_em([sum(name[p[0]][:4] == name[p[1]][:4] and common(*p) == k for p in every) for k in range(3)], u[1], (0.3, 0.3, 0.4))
    for (a, b), (score, _) in got.items():
        i, j = level(a, b), common(a, b)
        yes, no = 2e-4 * m[0][i] * m[1][j], (1 - 2e-4) * u[0][i] * u[1][j]
        assert score == pytest.approx(yes / (yes + no), abs=1e-4)


def test_rarest_gram(spark):
    """Names with one beginning don't meet on it."""
    long = spark.createDataFrame([(i, f"kvikmynd um {chr(97 + i % 26)}{i:03d}") for i in range(300)], "r int, rn string")
    short = spark.createDataFrame([(i, f"um {chr(97 + i % 26)}{i:03d}") for i in range(300)] + [(999, "um zzzzz")], "l int, ln string")
    got = entities.containment(short, long)
    assert rows(got, "l", "r", "exact") == sorted([(i, i, False) for i in range(300)], key=str)
    grams = long.withColumn("g", F.explode(entities.grams("rn"))).groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    chosen = entities.rarest(short, "ln", grams)
    met = chosen.join(long.withColumn("g", F.explode(entities.grams("rn"))), "g").count()
    first = short.withColumn("g", F.substring("ln", 1, 5)).join(long.withColumn("g", F.explode(entities.grams("rn"))), "g").count()
    assert chosen.filter("l = 999").count() == 0 and met <= 300 * 11 and met < 0.3 * first


def test_dedupe_writes_no_pairs_of_a_prefix(spark):
    """Pairs of one prefix that can't reach the threshold are counted, neither written nor shuffled."""
    from .test_stored import shuffled

    rng = random.Random(6)
    e = spark.createDataFrame([(i, "abcd" + "".join(rng.choices("efghijklmnop", k=6))) for i in range(1500)], "id long, name_fold string")
    w = spark.createDataFrame([(i, i // 2 if i < 40 else i) for i in range(1500)], "id long, work long")
    assert shuffled(spark, lambda: entities.dedupe(e, w, sample=500).collect()) < 200_000


def test_prefix_pairs(spark):
    """As many as compare makes of them, also where ids repeat under other names and meet in several prefixes."""
    rng = random.Random(7)
    e = spark.createDataFrame([(rng.randint(0, 60), rng.choice(["anna", "bera", "cara"]) + rng.choice("xyz")) for _ in range(90)] + [(3, None), (70, None)], "id long, name_fold string")
    w = spark.createDataFrame([(i, i % 25) for i in range(61)] + [(i, 100 + i % 23) for i in range(61)] + [(3, None)], "id long, work long")
    pairs = entities.by_prefix(e).distinct()
    want = entities.compare(pairs, e, w, exact=False).filter("a is not null")
    assert entities.prefix_pairs(e, most=8) == want.count()
    shared = entities.common_works(w)
    some = entities.compare(entities.near(shared, e), e, None, exact=False)
    kinds = lambda df: sorted(tuple(r) for r in df.select("a", "b", "shared", "name_level", "work_level").collect())
    every = entities.compare(pairs.unionByName(entities.by_works(w)).distinct(), e, w, exact=False)
    assert kinds(some) == kinds(every.filter("shared > 0"))
    alone = entities.compare(entities.prefix_only(e, shared, most=8, likely=False), e, None, exact=False)
    assert kinds(alone) == kinds(every.filter("shared = 0"))
