"""Hybrid retrieval: chunks, hashed dense vectors, a BM25 index, and reciprocal rank fusion, all as relations.

The inverted index is three frames: postings(term, id, tf), lengths(id, len) and idf(term, idf). Queries are frames too, so
a set of questions is one join on terms and one dense pass, not a loop.
"""

from __future__ import annotations

import json
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.python import best_by_hash, best_by_terms, hashed_rows, posted
from ..sources.scratch import keep
from .blockmax import best

# BM25's parameters, fusion's constant and depth, and the hashed vectors' length.
K1, B, FUSION, DEPTH, DIM = 1.5, 0.75, 60, 200, 512


def terms(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(id, term), one row per occurrence."""
    return df.select(F.col(key).alias("id"), F.explode(X.tokens(text)).alias("term"))


def index(df: DataFrame, key: str = "id", text: str = "text", only: DataFrame | None = None) -> dict[str, DataFrame]:
    """postings, lengths and idf of a corpus; documents without terms count in N. only: the terms (term) that will be asked for;
    no other postings are made or shuffled then."""
    toks = df.select(F.col(key).alias("id"), X.tokens(text).alias("t"))
    lengths = toks.select("id", F.size("t").cast("long").alias("len"))
    n = df.agg(F.count(F.lit(1)).alias("N"))  # one row
    every = toks.select("id", F.explode("t").alias("term"))
    if only is None:
        seen = toks.select(F.explode(F.array_distinct("t")).alias("term"))
        postings = every.groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))
    else:
        # the semi-join comes before the aggregate, so occurrences of other terms aren't shuffled where the terms fit a broadcast
        postings = every.join(only.select("term").distinct(), "term", "left_semi").groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))
        seen = postings.select("term")
    idf = seen.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("term", "df", F.log(1 + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    return {"postings": postings, "lengths": lengths, "idf": idf}


def bm25(ix: dict[str, DataFrame], queries: DataFrame) -> DataFrame:
    """(q, id, score) for queries(q, text); a query's terms count once."""
    asked = asked_terms(queries)
    mean = ix["lengths"].agg(F.avg("len").alias("mean"))  # one row
    hits = asked.join(ix["postings"], "term").join(ix["idf"].select("term", "idf"), "term").join(ix["lengths"], "id").crossJoin(F.broadcast(mean))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return hits.groupBy("q", "id").agg(F.sum(part).alias("score"))


def asked_terms(queries: DataFrame) -> DataFrame:
    return queries.select("q", F.explode(F.array_distinct(X.tokens("text"))).alias("term"))


def ranked(scores: DataFrame, depth: int) -> DataFrame:
    """The best `depth` of each query with their rank from 0; equal scores go by id."""
    w = Window.partitionBy("q").orderBy(F.desc(F.round("score", 9)), "id")
    return scores.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < depth)


def hashed(df: DataFrame, key: str = "id", text: str = "text", dim: int = DIM) -> DataFrame:
    """(id, bucket, weight): sparse unit vectors of term counts by hash bucket."""
    n = terms(df, key, text).withColumn("bucket", X.hashed_bucket("term", dim)).groupBy("id", "bucket").agg(F.count(F.lit(1)).alias("n"))
    norm = n.groupBy("id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return n.join(norm, "id").select("id", "bucket", (F.col("n") / F.col("norm")).alias("weight"))


def dense(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, id, score): dot products of sparse vectors that share a bucket."""
    q = queries.select(F.col("id").alias("q"), "bucket", F.col("weight").alias("w"))
    return vectors.join(q, "bucket").groupBy("q", "id").agg(F.sum(F.col("weight") * F.col("w")).alias("score"))


def nearest(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """Top k of full vectors (id, vector) by dot product with one query."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("id", X.dot("vector", q).alias("score")).orderBy(F.desc(F.round("score", 9)), "id").limit(k)


def fuse(lists: list[DataFrame], k: int) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (q, id, rank): the top k of each query."""
    votes = None
    for one in lists:
        part = one.select("q", "id", (1 / (FUSION + F.col("rank"))).alias("vote"))
        votes = part if votes is None else votes.unionByName(part)
    total = votes.groupBy("q", "id").agg(F.sum("vote").alias("score"))
    return ranked(total, k).withColumnRenamed("score", "rrf")


def dense_best(df: DataFrame, queries: DataFrame, depth: int, key: str = "id", text: str = "text") -> DataFrame:
    """(q, id, score): the `depth` best texts of each question by the dense similarity. Questions go to every row as a matrix;
    each batch of rows is scored there and cut to each question's best, so the output never is questions x texts."""
    return best_by_hash(df.select(F.col(key).alias("id"), X.tokens(text).alias("t")), hashed(queries, "q", "text"), depth, DIM, keep)


def apart(toks: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows (id, ..) whose id is their own, and those that share one or have none (None where there are none)."""
    shared = keep(toks.sparkSession, toks.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or id is null").select(F.col("id").alias("_shared")), "shared")
    if shared.isEmpty():
        return toks, None
    same = F.col("id").eqNullSafe(F.col("_shared"))
    return toks.join(shared, same, "left_anti"), toks.join(shared, same, "left_semi")


def sparse_best(df: DataFrame, queries: DataFrame, depth: int, key: str = "id", text: str = "text") -> DataFrame:
    """(q, id, score): the `depth` best texts of each question by BM25, and more; the caller ranks. Questions' terms go to every
    row, which is scored there, so neither postings nor questions x texts are shuffled; rows that share an id are summed up as `bm25`
    does it."""
    spark = df.sparkSession
    toks = df.select(F.col(key).alias("id"), X.tokens(text).alias("t"))
    whole = toks.agg(F.count(F.lit(1)).alias("N"), F.avg(F.size("t")).alias("mean")).first()
    asked = keep(spark, asked_terms(queries), "asked")
    only = asked.select("term").distinct()
    own, shared = apart(toks)
    seen = own.select(F.explode(F.array_distinct("t")).alias("term")).join(only, "term", "left_semi")
    if shared is not None:
        postings = shared.select("id", F.explode("t").alias("term")).join(only, "term", "left_semi").groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))
        seen = seen.unionByName(postings.select("term"))
    idf = F.log(1 + (F.lit(float(whole.N)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = seen.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", idf.alias("idf"))
    asked = keep(spark, asked.join(known, "term").select("q", "term", "idf"), "asked")
    mean = float(whole.mean or 1)
    out = best_by_terms(own, asked.select(F.col("q").alias("id"), "term", "idf"), depth, mean, K1, B, keep)
    if shared is not None:
        lengths = shared.select("id", F.size("t").alias("len"))
        part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(mean)))
        out = out.unionByName(asked.join(postings, "term").join(lengths, "id").groupBy("q", "id").agg(F.sum(part).alias("score")).select("q", "id", "score"))
    return out


def with_similarity(df: DataFrame, a: str, b: str, name: str, dim: int = DIM) -> DataFrame:
    """df with the cosine of two texts' hashed term counts. Buckets are columns of their own, made once a row."""
    for col in (a, b):
        df = df.withColumn(f"{col}_b", F.transform(X.tokens(col), lambda t: X.hashed_bucket(t, dim)))
    x, y = F.col(f"{a}_b"), F.col(f"{b}_b")
    times = lambda xs, v: F.size(F.filter(xs, lambda z: z == v)).cast("double")
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, v: s + v)
    norm = lambda xs: F.sqrt(total(F.transform(F.array_distinct(xs), lambda v: times(xs, v) * times(xs, v))))
    dot = total(F.transform(F.array_intersect(x, y), lambda v: times(x, v) * times(y, v)))
    return df.withColumn(name, F.coalesce(dot / F.nullif(norm(x) * norm(y), F.lit(0.0)), F.lit(0.0))).drop(f"{a}_b", f"{b}_b")


def hybrid(df: DataFrame, queries: DataFrame, k: int = 5, key: str = "id", text: str = "text") -> DataFrame:
    """(q, id, rank, rrf, score): fused ranks; score is the dense similarity, whatever the rank came from. It is worked out anew
    for the few rows that are left, so neither list is made twice."""
    d = dense_best(df, queries, DEPTH, key, text)
    # k rows a question, written, so the plan knows how few they are and doesn't shuffle the texts for them
    fused = keep(df.sparkSession, fuse([ranked(d, DEPTH), ranked(sparse_best(df, queries, DEPTH, key, text), DEPTH)], k), "fused")
    rows = fused.join(df.select(F.col(key).alias("id"), F.col(text).alias("_text")), "id").join(queries.select("q", F.col("text").alias("_asked")), "q")
    return with_similarity(rows, "_text", "_asked", "_s").select("q", "id", "rank", "rrf", F.round("_s", 4).alias("score"))


def search(ix: dict[str, DataFrame], query: str, k: int = 5) -> DataFrame:
    """(rank, id, type, text, score, mode) of one question over a stored index: hybrid, or dense where no chunk holds a word of
    it. Only postings of the question's terms are read."""
    spark = ix["texts"].sparkSession
    q = spark.range(1).select(F.lit(0).alias("q"), F.lit(query).alias("text"))
    found = hybrid_stored(ix, q, k)
    texts = ix["texts"].join(F.broadcast(found.select("id")), "id", "left_semi")  # k rows
    mode = asked_of(ix, asked_terms(q)).agg(F.count(F.lit(1)).alias("n")).select(F.when(F.col("n") > 0, "hybrid").otherwise("dense").alias("mode"))  # one row
    rows = found.join(texts.select("id", F.col("metadata")["type"].alias("type"), "text"), "id")
    return rows.crossJoin(F.broadcast(mode)).select("rank", "id", "type", "text", "score", "mode").orderBy("rank")


#: Embedders by name: frame, key, text -> (id, bucket, weight). Others may be added.
EMBEDDERS = {"hash": hashed}
#: Those whose vector of a text needs no other text: rows (id, t array of terms) -> (id, bucket array, weight array), unshuffled.
ROWWISE = {"hash": lambda rows: hashed_rows(rows, DIM)}

# Buckets of terms, documents in a shard at most, postings in a block, and files of a bucket at most.
BUCKETS, SHARD, RUN, SPLIT = 64, 8192, 64, 16


def store(df: DataFrame, folder: str, backend: str = "hash", key: str = "id", text: str = "text", buckets: int = BUCKETS, shard: int = SHARD) -> None:
    """Write the index of a corpus: postings and terms in folders by the term's hash, sorted by term; vectors; texts; and one row
    of what the whole corpus has.

    A posting row is a (term, shard): ids in order, what each multiplies the idf with, and the largest of every RUN of them. A shard
    is at most `shard` rows of one task, so what is shuffled is finished lists, not single postings; rows that share an id are gathered first.
    """
    spark = df.sparkSession
    ids = df.select(F.col(key).alias("id"), X.tokens(text).alias("t"))
    whole = ids.agg(F.count(F.lit(1)).alias("N"), F.avg(F.size("t")).alias("mean")).first()
    mean = float(whole.mean or 1)
    own, shared = apart(ids)
    rows = posted(own, mean, K1, B, shard, RUN)
    if shared is not None:
        rows = rows.unionByName(_gathered(shared, mean, max(1, -(-whole.N // shard))))
    rows = rows.select(_bucket("term", buckets).alias("bucket"), "term", "shard", "ids", "parts", "tops")
    rows = rows.repartition("bucket", F.pmod(F.xxhash64("shard"), F.lit(SPLIT))).sortWithinPartitions("bucket", "term", "shard")
    packed(rows).partitionBy("bucket").parquet(f"{folder}/postings.parquet")
    kept = spark.read.schema(rows.schema).parquet(f"{folder}/postings.parquet")
    df_ = kept.groupBy("bucket", "term").agg(F.sum(F.size("ids")).alias("df"))
    idf = F.log(1 + (F.lit(float(whole.N)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms_ = df_.withColumn("idf", idf)
    packed(terms_.repartition("bucket").sortWithinPartitions("bucket", "term")).partitionBy("bucket").parquet(f"{folder}/terms.parquet")
    vectors = ROWWISE[backend](own) if backend in ROWWISE else None
    if vectors is None or shared is not None:
        some = df if vectors is None else df.join(shared.select(F.col("id").alias("_shared")).distinct(), F.col(key).eqNullSafe(F.col("_shared")), "left_semi")
        v = EMBEDDERS[backend](some, key, text).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("bucket", "weight"))).alias("v"))  # DIM entries at most
        v = v.select("id", F.col("v.bucket").alias("bucket"), F.col("v.weight").alias("weight"))
        vectors = v if vectors is None else vectors.unionByName(v)
    packed(vectors).parquet(f"{folder}/vectors.parquet")
    extra = [F.col("metadata")] if "metadata" in df.columns else [F.lit(None).cast("map<string,string>").alias("metadata")]
    texts = df.select(F.col(key).alias("id"), F.col(text).alias("text"), *extra)
    packed(texts).parquet(f"{folder}/texts.parquet")
    schemas = F.create_map(*[F.lit(v) for name, part in (("postings", rows), ("terms", terms_), ("vectors", vectors), ("texts", texts)) for v in (name, part.schema.json())])
    spark.range(1).select(F.lit(backend).alias("backend"), F.lit(DIM).alias("dim"), F.lit(buckets).alias("buckets"), F.lit(whole.N).cast("long").alias("N"), F.lit(float(whole.mean or 0)).alias("mean"), schemas.alias("schemas")).write.mode("overwrite").json(f"{folder}/meta")


def packed(df: DataFrame):
    """A writer of a part of an index; most of it is read seldom, so its size comes first."""
    return df.write.mode("overwrite").option("compression", "zstd")


def _gathered(toks: DataFrame, mean: float, shards: int) -> DataFrame:
    """Posting lists, as `posted` makes them, of rows (id, t) that share ids: gathered by id, in shards by the id's hash (below 0)."""
    n = toks.select("id", F.size("t").alias("len"), F.explode("t").alias("term")).groupBy("term", "id", "len").agg(F.count(F.lit(1)).alias("tf"))
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(mean)))
    rows = n.select("term", (-1 - F.pmod(F.xxhash64("id"), F.lit(shards))).alias("shard"), F.struct("id", part.alias("part")).alias("p"))
    rows = rows.groupBy("term", "shard").agg(F.sort_array(F.collect_list("p")).alias("p"))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("p") - 1) / RUN).cast("int")), lambda i: F.array_max(F.transform(F.slice("p", i * RUN + 1, RUN), lambda x: x["part"])))
    return rows.select("term", "shard", F.col("p.id").alias("ids"), F.col("p.part").alias("parts"), runs.alias("tops"))


def _bucket(term, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def load(spark, folder: str) -> dict[str, DataFrame]:
    meta = spark.read.schema("backend string,dim int,buckets int,N long,mean double,schemas map<string,string>").json(f"{folder}/meta")
    known = meta.first().schemas
    ix = {name: spark.read.schema(T.StructType.fromJson(json.loads(known[name]))).parquet(f"{folder}/{name}.parquet") for name in known}
    return ix | {"meta": meta}


def asked_of(ix: dict[str, DataFrame], asked: DataFrame) -> DataFrame:
    """asked(q, term) with idf, for terms that the index has. Folders of other buckets aren't read: which are asked for is a set
    of at most `buckets` numbers."""
    n = ix["meta"].first().buckets
    a = asked.withColumn("bucket", _bucket("term", n))
    some = sorted(r.bucket for r in a.select("bucket").distinct().collect())
    return a.join(ix["terms"].filter(F.col("bucket").isin(some)), ["bucket", "term"]).select("q", "bucket", "term", "idf")


def pruned(ix: dict[str, DataFrame], asked: DataFrame) -> DataFrame:
    """Posting rows of asked(bucket, term): only their folders are listed and read, and in them only row groups whose terms may
    be among those asked for."""
    some = sorted(r.bucket for r in asked.select("bucket").distinct().collect())
    return ix["postings"].filter(F.col("bucket").isin(some))


def sparse_stored(ix: dict[str, DataFrame], queries: DataFrame, depth: int, block: int = 512, trace: bool = False) -> DataFrame:
    """(q, id, score): the `depth` best of each question in every shard by BM25, and what ties with them; the caller ranks. Each
    shard meets a block of questions and skips the posting blocks whose maxima are too low. trace: (q, opened, postings) instead."""
    spark = queries.sparkSession
    asked = keep(spark, asked_of(ix, asked_terms(queries)), "asked")
    blocks = max(1, -(-asked.agg(F.count_distinct("q")).first()[0] // block))
    groups = asked.groupBy("bucket", "term", "idf", F.pmod(F.xxhash64("q"), F.lit(blocks)).alias("block")).agg(F.collect_list("q").alias("qs"))
    q_kind, id_kind = queries.schema["q"].dataType.simpleString(), ix["vectors"].schema["id"].dataType.simpleString()

    def shard(rows: pa.Table) -> pa.Table:
        ids = rows.column("ids").combine_chunks()
        names = pc.unique(ids.flatten())
        names = names.take(pc.sort_indices(names))
        place = pc.index_in(ids.flatten(), names).to_numpy().astype(np.int64)
        ends = np.cumsum(pc.list_value_length(ids).to_numpy())
        parts = rows.column("parts").combine_chunks().flatten().to_numpy()
        tops = rows.column("tops").combine_chunks()
        tops_ends, tops = np.cumsum(pc.list_value_length(tops).to_numpy()), tops.flatten().to_numpy()
        idf = rows.column("idf").to_numpy()
        lists, of = [], {}
        for i, (e, te) in enumerate(zip(ends, tops_ends, strict=True)):
            s, ts = (ends[i - 1], tops_ends[i - 1]) if i else (0, 0)
            stops = np.minimum(np.arange(RUN, RUN * (te - ts) + 1, RUN), e - s)
            lists.append((place[s:e], parts[s:e] * idf[i], stops, tops[ts:te] * idf[i]))
        for i, qs in enumerate(rows.column("qs").to_pylist()):
            for q in qs:
                of.setdefault(q, []).append(i)
        out = {"q": [], "id": [], "score": [], "opened": [], "postings": []}
        for q, at in of.items():
            seen = Counter()
            found, scores = best([lists[i] for i in at], depth, 2e-9, seen)
            if trace:
                for c, v in (("q", q), ("id", None), ("score", None), ("opened", seen["opened"]), ("postings", seen["postings"])):
                    out[c].append(v)
                continue
            out["q"] += [q] * len(found)
            out["id"] += names.take(pa.array(found, pa.int64())).to_pylist()
            out["score"] += scores.tolist()
            for c in ("opened", "postings"):
                out[c] += [0] * len(found)
        kinds = {"q": rows.schema.field("qs").type.value_type, "id": names.type, "score": pa.float64(), "opened": pa.int64(), "postings": pa.int64()}
        return pa.table({c: pa.array(v, kinds[c]) for c, v in out.items()})

    rows = pruned(ix, asked).join(groups, ["bucket", "term"]).select("shard", "block", "ids", "parts", "tops", "idf", "qs")
    got = rows.groupBy("shard", "block").applyInArrow(shard, f"q {q_kind}, id {id_kind}, score double, opened bigint, postings bigint")
    return got.groupBy("q").agg(F.sum("opened").alias("opened"), F.sum("postings").alias("postings")) if trace else got.select("q", "id", "score")


def hybrid_stored(ix: dict[str, DataFrame], queries: DataFrame, k: int = 5) -> DataFrame:
    """(q, id, rank, rrf, score) as `hybrid` gives it, from a stored index."""
    asked = hashed(queries, "q", "text")
    d = ranked(best_by_hash(ix["vectors"], asked, DEPTH, DIM, keep, stored=True), DEPTH)
    fused = keep(queries.sparkSession, fuse([d, ranked(sparse_stored(ix, queries, DEPTH), DEPTH)], k), "fused")  # few rows, so vectors aren't shuffled
    few = fused.join(ix["vectors"], "id").join(asked.groupBy(F.col("id").alias("q")).agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.col("weight").alias("w")))).alias("m")), "q")
    dot = F.aggregate(F.zip_with("bucket", "weight", lambda b, w: w * F.coalesce(F.try_element_at("m", b), F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    return few.select("q", "id", "rank", "rrf", F.round(dot, 4).alias("score"))


def keyword(df: DataFrame, words: str, n: int, text: str = "text") -> DataFrame:
    """The fallback without an index: containment in any case."""
    return df.filter(F.lower(text).contains(words.lower())).limit(n)


def chunk(df: DataFrame, kind: str, key: str = "id", text: str = "text", size: int = 900, overlap: int = 120) -> DataFrame:
    """(id, text, metadata) of a record kind's chunks, numbered within the record."""
    rows = df.select(F.col(key).alias("_k"), F.posexplode(X.chunks(text, size, overlap)).alias("n", "text"))
    return rows.select(F.concat_ws("#", F.lit(kind), F.col("_k").cast("string"), F.col("n").cast("string")).alias("id"), "text", F.create_map(F.lit("type"), F.lit(kind), F.lit("key"), F.col("_k").cast("string")).alias("metadata"))


def boilerplate(df: DataFrame, least: int = 8, key: str = "id", text: str = "text", pattern: str = X.SENTENCE_END) -> DataFrame:
    """(sentence, docs): sentences of 16 to 219 characters in `least` documents or more."""
    s = df.select(F.explode(F.array_distinct(F.transform(F.split(text, pattern), lambda v: F.trim(v)))).alias("sentence"))
    return s.filter((F.length("sentence") > 15) & (F.length("sentence") < 220)).groupBy("sentence").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= least)


def strip_boilerplate(df: DataFrame, frequent: DataFrame, key: str = "id", text: str = "text", pattern: str = X.SENTENCE_END) -> DataFrame:
    """(id, text) without the frequent sentences, the rest as lines in order. Rows that share an id and a text share their
    result; those that share an id only keep their own lines."""
    base = df.select(F.col(key).alias("id"), F.col(text).alias("text"), F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256).alias("h"))
    once = base.dropDuplicates(["id", "h"])
    s = once.select("id", "h", F.posexplode(F.split("text", pattern)).alias("pos", "raw")).withColumn("sentence", F.trim("raw"))
    kept = s.filter("sentence != ''").join(frequent.select("sentence"), "sentence", "left_anti")
    lines = kept.groupBy(F.col("id").alias("_id"), F.col("h").alias("_h")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), "\n").alias("lines"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))
    return base.join(lines, same, "left").select("id", F.coalesce("lines", F.lit("")).alias("text"))
