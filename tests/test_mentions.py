"""Dictionary matching, key components and large crews against plain versions."""

import random

import pytest

from tindra.functions import automaton as A
from tindra.operators import entities, graph, mentions

from .test_operators import rows


def corpus(rng, n=60):
    return ["".join(rng.choices("abcá日 ", k=rng.randint(0, 300))) for _ in range(n)] + ["", "ab" * 3000, "日" * 50]


def aliases(rng, n=80):
    return sorted({"".join(rng.choices("abcá日", k=rng.randint(1, 6))) for _ in range(n)} | {"ab" * 20, "zzz", "abab"})


@pytest.mark.parametrize("piece", [7, 64, 1024])
def test_automaton(monkeypatch, piece):
    rng = random.Random(piece)
    monkeypatch.setattr(A, "PIECE", piece)
    words, texts = aliases(rng), corpus(rng)
    made = A.build(words, list(range(1, len(words) + 1)))
    want = {}
    for i, t in enumerate(texts):
        for j, w in enumerate(words):
            if n := sum(t.startswith(w, k) for k in range(len(t))):
                want[i, j] = n
    who, which, n = (x.tolist() for x in A.counts(made, texts, len(words)))
    assert dict(zip(zip(who, which, strict=True), n, strict=True)) == want
    assert A.best_of(made, texts).tolist() == [max((j + 1 for (x, j) in want if x == i), default=0) for i in range(len(texts))]


@pytest.mark.parametrize("cells", [400, mentions.CELLS])
def test_mentions(spark, cells):
    rng = random.Random(5)
    words, texts = aliases(rng, 40), [*corpus(rng, 40), None]
    a = spark.createDataFrame([(w, i + 100) for i, w in enumerate(words)] + [("abab", 1), ("", 0), (None, 0)], "alias string, ord long")
    t = spark.createDataFrame([(i % 50, x) for i, x in enumerate(texts)], "id long, text string").repartition(3)
    order = {w: i + 100 for i, w in enumerate(words)} | {"abab": 1}
    hits = [(i % 50, x, [w for w in order if x and w in x]) for i, x in enumerate(texts)]
    want = sorted(((i, order[min(ws, key=lambda w: (-len(w), order[w]))] if ws else None) for i, _, ws in hits), key=str)
    assert rows(mentions.longest(t, a, cells)) == want
    counted = sorted(((i, order[w], sum(x.startswith(w, k) for k in range(len(x)))) for i, x, ws in hits for w in ws), key=str)
    assert rows(mentions.mentions(t, a, cells)) == counted
    assert len(list(mentions.blocks(a, 400))) >= 3


def test_no_aliases(spark):
    t = spark.createDataFrame([(1, "x")], "id long, text string")
    none = spark.createDataFrame([], "alias string, ord long")
    assert rows(mentions.longest(t, none)) == [(1, None)] and mentions.mentions(t, none).count() == 0


def test_key_components(spark):
    """Three keys over two names are one entity, whose first key stays; a name alone is one; neither key nor name stands alone."""
    r = spark.createDataFrame([("k1", "a", 1), ("k2", "a", 2), ("k2", "b", 3), ("k3", "b", 4), (None, "b", 5), (None, "c", 6), ("k9", None, 7), ("k9", "d", 8), (None, None, 9), (None, "e", 10), ("k5", "e", 11)], "key string, norm string, ord int")
    want = [(1, 1, "k1"), (2, 1, "k1"), (3, 1, "k1"), (4, 1, "k1"), (5, 1, "k1"), (6, 6, None), (7, 7, "k9"), (8, 7, "k9"), (9, 9, None), (10, 10, "k5"), (11, 10, "k5")]
    assert rows(entities.strong_key_components(r)) == sorted(want, key=str)


def test_a_large_crew(spark):
    """A title with many people among small ones: the same edges whether it is cut or not."""
    credits = [(1, p) for p in range(120)] + [(2, p) for p in range(0, 120, 2)] + [(3, p) for p in (0, 2, 4)]
    df = spark.createDataFrame(credits, "title int, person int")
    cut, whole = graph.shared_titles(df, most=20), graph.shared_titles(df)
    assert rows(cut) == rows(whole) and cut.count() == 60 * 59 // 2
    assert cut.filter("a = 0 and b = 2").first().shared == 3


@pytest.mark.parametrize("piece", [7, 1024])
def test_mentions_without_overlap(spark, monkeypatch, piece):
    """As str.count and SQL's replace meet them, over the ends of pieces too."""
    monkeypatch.setattr(A, "PIECE", piece)
    rng = random.Random(9)
    words, texts = [*aliases(rng), "a", "aa", "aba"], [*corpus(rng), "aaaaa", "ababababa" * 9]
    words = sorted(set(words))
    made = A.build(words, [1] * len(words))
    who, which, n = (x.tolist() for x in A.counts(made, texts, len(words), A.np.array([len(w) for w in words])))
    assert dict(zip(zip(who, which, strict=True), n, strict=True)) == {(i, j): t.count(w) for i, t in enumerate(texts) for j, w in enumerate(words) if w in t}
    t, a = spark.createDataFrame([(1, "ababa aaa"), (2, None)], "id long, text string"), spark.createDataFrame([("aba", 1), ("aa", 2)], "alias string, ord long")
    assert rows(mentions.mentions(t, a, overlap=False)) == [(1, 1, 1), (1, 2, 1)] and rows(mentions.mentions(t, a)) == [(1, 1, 2), (1, 2, 2)]
