"""What the JVM has no function for: HTML entities, Jaro-Winkler and full NFKD folding (Arrow batches)."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def maybe_unescape(x: Column) -> Column:
    """Only texts with an ampersand make the way to Python and back."""
    return F.when(x.contains("&"), unescape(x)).otherwise(x)


@F.pandas_udf(T.StringType())
def fold_any(s: pd.Series) -> pd.Series:
    """Folding for all scripts, where functions.text.fold's Latin table isn't enough."""
    return s.fillna("").map(lambda t: "".join(ch for ch in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(ch)))


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used = [False] * len(b)
    hits = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                hits.append(ch)
                break
    if not hits:
        return 0.0
    other = [ch for ch, u in zip(b, used, strict=True) if u]
    swaps = sum(x != y for x, y in zip(hits, other, strict=True)) // 2
    m = len(hits)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str | None, b: str | None) -> float:
    a, b = a or "", b or ""
    j = jaro(a, b)
    same = 0
    while same < 4 and same < min(len(a), len(b)) and a[same] == b[same]:
        same += 1
    return j + 0.1 * same * (1 - j) if j > 0.7 else j


@F.pandas_udf(T.DoubleType())
def jaro_winkler_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def _tokens(dim: int):
    """Batches (id, array of terms) to ids and unit vectors of hashed term counts."""
    import hashlib

    import numpy as np

    bucket: dict[str, int] = {}

    def vectors(b):
        lists = b.column(1)
        flat, ends = lists.flatten().to_pylist(), lists.offsets.to_numpy()
        ends = ends - ends[0]
        if len(bucket) > 500_000:
            bucket.clear()
        for t in set(flat) - bucket.keys():
            bucket[t] = int(hashlib.md5(t.encode()).hexdigest()[-3:], 16) % dim
        cols = np.fromiter((bucket[t] for t in flat), np.int64, len(flat))
        for a in range(0, b.num_rows, SLICE):
            e = min(a + SLICE, b.num_rows)
            x = np.zeros((e - a, dim))
            np.add.at(x, (np.repeat(np.arange(e - a), np.diff(ends[a : e + 1])), cols[ends[a] : ends[e]]), 1.0)
            x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)
            yield b.column(0).slice(a, e - a), x

    return vectors


def _stored(dim: int):
    """Batches (id, buckets, weights) to ids and vectors."""
    import numpy as np

    def vectors(b):
        ends, cols, w = b.column(1).offsets.to_numpy(), b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy()
        ends = ends - ends[0]
        for a in range(0, b.num_rows, SLICE):
            e = min(a + SLICE, b.num_rows)
            x = np.zeros((e - a, dim))
            x[np.repeat(np.arange(e - a), np.diff(ends[a : e + 1])), cols[ends[a] : ends[e]]] = w[ends[a] : ends[e]]
            yield b.column(0).slice(a, e - a), x

    return vectors


def _dense(at, dim: int, vectors):
    """Scores of a bounded block of questions at(id, bucket, weight): their ids, and batches to row ids and a matrix questions x rows."""
    import numpy as np
    import pyarrow.compute as pc

    qs = pc.unique(at.column("id"))
    w = np.zeros((len(qs), dim))
    np.add.at(w, (pc.index_in(at.column("id"), qs).to_numpy(), at.column("bucket").to_numpy()), at.column("weight").to_numpy())

    def scores(b):
        for ids, x in vectors(b):
            yield ids, w @ x.T

    return qs, scores


def _sparse(at, mean: float, k1: float, b_: float):
    """The same by BM25 of a block at(id, term, idf), over batches (id, array of terms)."""
    import numpy as np
    import pyarrow.compute as pc

    qs, names = pc.unique(at.column("id")), pc.unique(at.column("term"))
    term = pc.index_in(at.column("term"), names).to_numpy()
    order = np.argsort(term, kind="stable")
    of = pc.index_in(at.column("id"), qs).to_numpy()[order]  # the questions of each term, one term after another
    starts = np.searchsorted(term[order], np.arange(len(names) + 1))
    idf = np.zeros(len(names))
    idf[term] = at.column("idf").to_numpy()
    # terms that many questions share are columns of a matrix, the others are added up by question
    common = np.flatnonzero(np.diff(starts) > max(1, len(qs) // 16))
    column = np.full(len(names), -1)
    column[common] = np.arange(len(common))
    w = np.zeros((len(qs), len(common)))
    at_common = column[term[order]]
    np.add.at(w, (of[at_common >= 0], at_common[at_common >= 0]), 1.0)

    def scores(b):
        lists = b.column(1)
        ends, size = lists.offsets.to_numpy().astype(np.int64), pc.list_value_length(lists).to_numpy()
        code = pc.fill_null(pc.index_in(lists.flatten(), names), -1).to_numpy()
        ends = ends - ends[0]
        for a in range(0, b.num_rows, SLICE):
            n = min(SLICE, b.num_rows - a)
            t, r = code[ends[a] : ends[a + n]], np.repeat(np.arange(n), size[a : a + n])
            key, tf = np.unique(r[t >= 0] * len(names) + t[t >= 0], return_counts=True)
            r, t = key // len(names), key % len(names)
            part = idf[t] * tf * (k1 + 1) / (tf + k1 * (1 - b_ + b_ * size[a + r] / mean))
            x, c = np.zeros((n, len(common))), column[t]
            x[r[c >= 0], c[c >= 0]] = part[c >= 0]
            r, t, part = r[c < 0], t[c < 0], part[c < 0]
            many = starts[t + 1] - starts[t]
            s, upto, i = (w @ x.T).ravel(), np.cumsum(many), 0
            while i < len(t):  # pieces of about HITS (question, posting) pairs
                e = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + HITS, side="right")))
                m = many[i:e]
                q = of[np.repeat(starts[t[i:e]] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
                s += np.bincount(q * n + np.repeat(r[i:e], m), np.repeat(part[i:e], m), len(s))
                i = e
            yield b.column(0).slice(a, n), s.reshape(len(qs), n)

    return qs, scores


def _best(rows, qs, scores, depth: int, q_kind: str):
    """(q, id, score): each question's `depth` best of every task. scores(batch) gives row ids and a matrix of scores."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    id_kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        held: dict = {"q": [], "id": [], "s": []}

        def cut(ids, s):
            """Each question's best of one batch and those kept so far: larger score first, then smaller id."""
            k = min(depth, len(ids))
            for b in range(0, len(qs), BLOCK):
                part = np.round(s[b : b + BLOCK], 9)
                floor = np.partition(part, len(ids) - k, axis=1)[:, len(ids) - k]
                q, r = np.nonzero((part >= floor[:, None]) & (s[b : b + BLOCK] > 0))
                held["q"].append(q + b)
                held["id"].append(ids.take(pa.array(r)))
                held["s"].append(s[b : b + BLOCK][q, r])

        def packed():
            q, s, i = np.concatenate(held["q"]), np.concatenate(held["s"]), pa.concat_arrays(held["id"])
            order = pc.sort_indices(pa.table({"q": q, "s": -np.round(s, 9), "id": i}), [("q", "ascending"), ("s", "ascending"), ("id", "ascending")]).to_numpy()
            q, s = q[order], s[order]
            ok = np.arange(len(q)) - np.searchsorted(q, q, side="left") < depth
            held["q"], held["s"], held["id"] = [q[ok]], [s[ok]], [i.take(pa.array(order[ok]))]

        for b in batches:
            for ids, s in scores(b):
                cut(ids, s)
                if sum(map(len, held["q"])) > 4 * depth * len(qs) + 100_000:
                    packed()
        if held["q"]:
            packed()
            yield pa.RecordBatch.from_arrays([qs.combine_chunks().take(pa.array(held["q"][0])) if isinstance(qs, pa.ChunkedArray) else qs.take(pa.array(held["q"][0])), held["id"][0], pa.array(held["s"][0])], ["q", "id", "score"])

    return rows.mapInArrow(run, f"q {q_kind}, id {id_kind}, score double")


def _in_blocks(rows, asked, depth: int, block, q_kind: str, keep, most: int | None = None):
    """(q, id, score) over asked(id, ..), dealt in blocks of about ASKED questions (and `most` rows) by their hash. One block at a time
    goes to the tasks, and where there are several, each block's result is written before the next one starts. block(table) gives its
    questions and their scores."""
    from pyspark.sql import functions as F

    n, size = asked.agg(F.count_distinct("id"), F.count(F.lit(1))).first()
    if not n:
        return rows.limit(0).select(F.lit(None).cast(q_kind).alias("q"), "id", F.lit(0.0).alias("score"))
    blocks, out = max(-(-n // ASKED), -(-size // most) if most else 1), None
    for k in range(blocks):
        at = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).toArrow()
        if at.num_rows:
            part = _best(rows, *block(at), depth, q_kind)
            part = keep(rows.sparkSession, part, "best") if blocks > 1 else part
            out = part if out is None else out.unionByName(part)
    return out


def best_by_hash(rows, questions, depth: int, dim: int, keep, stored: bool = False):
    """(q, id, score): the `depth` best rows of each question, and more, by the cosine of hashed term counts; the caller ranks.

    rows(id, t array of terms), or stored vectors rows(id, bucket array, weight array). questions(id, bucket, weight) are the
    questions' vectors, which go to the tasks as a matrix of a bounded size. keep(spark, frame, name) writes a frame and reads it
    back.
    """
    from pyspark.sql import functions as F

    rows = rows.filter(F.size(rows.columns[1]) > 0)
    asked = keep(rows.sparkSession, questions, "questions")
    vectors = (_stored if stored else _tokens)(dim)
    return _in_blocks(rows, asked, depth, lambda at: _dense(at, dim, vectors), questions.schema["id"].dataType.simpleString(), keep)


def best_by_terms(rows, asked, depth: int, mean: float, k1: float, b: float, keep):
    """(q, id, score): the `depth` best of rows(id, t array of terms) by BM25, and more; the caller ranks. asked(id, term, idf) is
    written."""
    from pyspark.sql import functions as F

    rows = rows.filter(F.size("t") > 0)
    return _in_blocks(rows, asked, depth, lambda at: _sparse(at, mean, k1, b), asked.schema["id"].dataType.simpleString(), keep, 1_000_000)


def hashed_rows(rows, dim: int):
    """(id, bucket array, weight array) of rows(id, t array of terms) that have terms, each row by itself."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import functions as F

    vectors = _tokens(dim)

    def run(batches):
        for b in batches:
            for ids, x in vectors(b):
                r, c = np.nonzero(x)
                ends = np.searchsorted(r, np.arange(len(ids) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(ends, c.astype(np.int32)), pa.ListArray.from_arrays(ends, x[r, c])], ["id", "bucket", "weight"])

    return rows.filter(F.size("t") > 0).mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, bucket array<int>, weight array<double>")


def posted(rows, mean: float, k1: float, b_: float, shard: int, run_: int):
    """(term, shard, ids, parts, tops) of rows(id, t array of terms) whose ids differ: posting lists of shards of at most `shard` rows
    and about WORDS words. A shard is rows of one task, so nothing is shuffled."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql import functions as F

    def lists(ids, words, size, number):
        order = pc.sort_indices(ids)
        rank = np.empty(len(ids), np.int64)
        rank[order.to_numpy()] = np.arange(len(ids))
        ids, length = ids.take(order), size[order.to_numpy()]
        coded = words.dictionary_encode()
        key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(ids) + np.repeat(rank, size), return_counts=True)
        term, row = key // len(ids), key % len(ids)
        part = tf * (k1 + 1) / (tf + k1 * (1 - b_ + b_ * length[row] / mean))
        ends = np.searchsorted(term, np.arange(len(coded.dictionary) + 1))
        runs = -(-np.diff(ends) // run_)
        run_ends = np.concatenate([[0], np.cumsum(runs)])
        starts = np.repeat(ends[:-1], runs) + run_ * (np.arange(run_ends[-1]) - np.repeat(run_ends[:-1], runs))
        tops = np.maximum.reduceat(part, starts)
        as_lists = lambda e, v: pa.ListArray.from_arrays(e.astype(np.int32), v)
        return pa.RecordBatch.from_arrays(
            [coded.dictionary, pa.array(np.full(len(runs), number)), as_lists(ends, ids.take(pa.array(row))), as_lists(ends, part), as_lists(run_ends, tops)], ["term", "shard", "ids", "parts", "tops"]
        )

    def run(batches):
        from pyspark import TaskContext

        number, held, n, words = TaskContext.get().partitionId() << 20, [], 0, 0

        def packed():
            ids, flat, size = ([x[c] for x in held] for c in range(3))
            return lists(pa.concat_arrays(ids), pa.concat_arrays(flat), np.concatenate(size), number)

        for b in batches:
            for a in range(0, b.num_rows, SLICE):
                at = b.slice(a, SLICE)
                size = pc.list_value_length(at.column(1)).to_numpy()
                lo = 0
                while lo < len(size):
                    fit = int(np.searchsorted(np.cumsum(size[lo:]), WORDS - words, side="right"))
                    take = min(shard - n, len(size) - lo, max(fit, 0 if n else 1))
                    if take:
                        held.append((at.column(0).slice(lo, take), at.column(1).slice(lo, take).flatten(), size[lo : lo + take]))
                        n, words, lo = n + take, words + int(size[lo : lo + take].sum()), lo + take
                    if n == shard or lo < len(size):
                        yield packed()
                        number, held, n, words = number + 1, [], 0, 0
        if held:
            yield packed()

    id_kind = rows.schema["id"].dataType.simpleString()
    return rows.filter(F.size("t") > 0).mapInArrow(run, f"term string, shard bigint, ids array<{id_kind}>, parts array<double>, tops array<double>")


#: Rows of a matrix, questions of a partial sort, questions (on average) that go to the tasks at a time, pairs of a question and a
#: posting that are added up at a time, and words of a shard.
SLICE, BLOCK, ASKED, HITS, WORDS = 2048, 256, 2048, 2_000_000, 4_000_000
