"""Ranked search against plain scoring of every document; blocks against the best of all cuts; skipping at work."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tindra.llm import wand


def words(t):
    return re.findall("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain(docs, items, top=10):
    rows = [(i, Counter(w), len(w)) for i, t in docs if (w := words(t))]
    n, total, df = len(rows), sum(x for *_, x in rows), Counter(t for _, c, _ in rows for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(words(t))
    out = []
    for q, terms in asked.items():
        found = []
        for i, c, size in rows:
            m = 100 - 90 + 90 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                found.append((-s, i is None, i))
        out += [(q, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out)


def run(spark, docs, items, parts=3, **more):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, term string").repartition(parts)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score int")
    return sorted(map(tuple, wand.rank(spark, d, q, **more).collect()))


def corpus(rng, n=400):
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünï", "日本", "x_y", "a-b", "I.T", "ß", "É"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 60)))) for i in range(n)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 9)))) for i in range(30)]
    return docs, items


@pytest.mark.parametrize("more", [{}, {"most_asked": 3}, {"a_block": 4}])
def test_plain(spark, odd, more):
    docs, items = corpus(random.Random(1))
    docs += odd + [(1000 + i, "w1 w2 hot copy") for i in range(150)] + [(7, "w3 w4")] * 2 + [(None, "w59 w58"), (None, None)]
    items += [(100, None), (101, ""), (102, "nowhere at all"), (None, "w1"), (103, "hot COPY"), (103, "w2"), (103, "w2"), (104, "lang words"), (105, "x" * 50_000)]
    assert run(spark, docs, items, **more) == plain(docs, items)


def test_shards_of_any_size_agree(spark, monkeypatch):
    docs, items = corpus(random.Random(2))
    want = plain(docs, items)
    monkeypatch.setattr(wand.postings, "__defaults__", (None, "doc_id", "text", 37, 90))
    assert run(spark, docs, items, 5) == want


def test_empty(spark):
    docs, items = corpus(random.Random(3), 5)
    assert run(spark, [], items) == run(spark, docs, []) == run(spark, [(1, None), (2, "..")], items) == []


def test_cuts_are_the_best():
    """Dynamic programming against every way to cut short lists; long lists stay within a grid."""
    rng = np.random.default_rng(4)
    lists = [rng.choice([1, 5, 9, 300, 900], size=n).astype(np.int64) for n in (1, 2, 7, 9, 10)]
    for x, ends in zip(lists, wand.cuts(lists, open_=0.5), strict=True):
        def cost(e, x=x):
            return sum(int(x[a:b].max()) * (b - a) + 0.5 * x.mean() for a, b in itertools.pairwise([0, *e]))

        ways = [[*c, len(x)] for k in range(len(x)) for c in itertools.combinations(range(1, len(x)), k)]
        assert cost(ends.tolist()) == pytest.approx(min(map(cost, ways)))
    (ends,) = wand.cuts([rng.integers(1, 1000, 10_000)], open_=0.1)
    assert ends[-1] == 10_000 and (np.diff(ends) > 0).all() and len(ends) <= wand.GRID
    assert [len(e) for e in wand.cuts([np.zeros(0, np.int64)])] == [0]


def test_blocks_are_skipped():
    """Few postings are opened where some blocks are much higher than the rest, and the result is still exact."""
    rng = np.random.default_rng(6)
    lists = []
    for df in (5000, 3000, 900, 40):
        place = np.sort(rng.choice(8192, df, replace=False)).astype(np.int32)
        x = rng.integers(1000, 2000, df)
        x[(place > 4000) & (place < 4200)] += rng.integers(50_000, 90_000)
        (ends,) = wand.cuts([x])
        c = x * int(1000 * math.log(8193 / df))
        lists.append((place, c, ends, np.maximum.reduceat(c, np.concatenate([[0], ends[:-1]]))))
    seen = Counter()
    places, scores = wand.best(lists, trace=seen)
    every = np.zeros(8192, np.int64)
    for p, c, _, _ in lists:
        every[p] += c
    want = np.lexsort((np.arange(8192), -every))[:10]
    assert places.tolist() == want.tolist() and scores.tolist() == every[want].tolist()
    assert seen["opened"] < 0.2 * seen["postings"]
