"""The fold of full credits onto the spine by strong keys: facts of titles, people, companies, and recomputed roll-ups.

A record's key decides first, then its norm, then it is new. Phases over frames stand for that sequence (see
entities.strong_key_upsert); order is (title, category, place in the list), which files give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import entities as E
from . import spine as S

# Categories under another name, and company types by category.
ROLE_NAMES = {"actor": "cast", "actress": "cast"}
COMPANY_TYPES = {"production": "production", "distribution": "distribution", "sales": "sales", "specialEffects": "vfx", "miscellaneous": "misc"}


def title_facts(titles: DataFrame, files: DataFrame) -> DataFrame:
    """titles(id, tconst) with rating, votes, genres and countries of their file; a title without one keeps nulls."""
    facts = files.select(F.col("imdb_tconst").alias("tconst"), "rating", "votes", F.to_json(F.coalesce("genres", F.array().cast("array<string>"))).alias("genres_json"), F.to_json(F.coalesce("countries", F.array().cast("array<string>"))).alias("countries_json"), F.lit(True).alias("enriched"))
    return titles.join(facts, "tconst", "left").withColumn("enriched", F.coalesce("enriched", F.lit(False)))


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    return S.with_ids(rows, *order).withColumnRenamed("id", "ord")


def upsert(known: DataFrame, records: DataFrame, norm: Column) -> tuple[DataFrame, DataFrame]:
    """known(id, norm); records(ord, key, name, ...). Returns records with entity, and claims(entity, key, name, is_new): the
    first key that each entity is seen with, which it keeps."""
    base = known.select((-F.col("id")).alias("ord"), F.lit(None).cast("string").alias("key"), "norm")
    new = records.select("ord", F.nullif("key", F.lit("")).alias("key"), norm.alias("norm")).filter("norm != '' or key is not null")
    # a record without a name stands under its key alone
    new = new.withColumn("norm", F.when(F.col("norm") != "", F.col("norm")).otherwise(F.concat(F.lit("\u0000"), "key")))
    most = known.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("most"))  # one row
    found = E.strong_key_upsert(base.unionByName(new)).filter("ord > 0").crossJoin(F.broadcast(most))
    found = found.select("ord", F.when(F.col("entity") < 0, -F.col("entity")).otherwise(F.col("most") + F.col("entity")).alias("entity"), (F.col("entity") > 0).alias("is_new"))
    rows = records.join(found, "ord")
    claims = rows.groupBy("entity", "is_new").agg(F.min_by("key", F.when(F.coalesce("key", F.lit("")) != "", F.col("ord"))).alias("key"), F.min_by("name", "ord").alias("name"))
    return rows, claims


def people(titles: DataFrame, files: DataFrame, known: DataFrame, closed: DataFrame) -> dict[str, DataFrame]:
    """Credits (title_id, person_id, role, job), one an edge, and claims. known people(id, norm); redirects are honoured."""
    rows = files.join(titles.select(F.col("id").alias("title_id"), F.col("tconst").alias("imdb_tconst")), "imdb_tconst").select("title_id", F.explode("crew").alias("category", "people"))
    rows = rows.select("title_id", "category", F.posexplode("people").alias("pos", "p")).select("title_id", "category", "pos", F.col("p.nconst").alias("key"), F.col("p.name").alias("name"), F.col("p.job").alias("job"))
    rows = E.apply_redirects(_numbered(rows, "title_id", "category", "pos").withColumn("norm", X.name_norm("name")), "norm", closed)
    rows, claims = upsert(known, rows, F.col("norm"))
    role = X.relabel("category", ROLE_NAMES)
    edges = rows.withColumn("role", role).withColumn("n", F.row_number().over(Window.partitionBy("title_id", "entity", "role").orderBy("ord"))).filter("n = 1")
    return {"credit": edges.select("title_id", F.col("entity").alias("person_id"), "role", "job"), "claim": claims}


def companies(titles: DataFrame, files: DataFrame, known: DataFrame, closed: DataFrame) -> dict[str, DataFrame]:
    """Company edges (title_id, company_id, role), the first role of each, and claims with the type of the first record."""
    rows = files.join(titles.select(F.col("id").alias("title_id"), F.col("tconst").alias("imdb_tconst")), "imdb_tconst").select("title_id", F.explode("companies").alias("category", "firms"))
    rows = rows.select("title_id", "category", F.posexplode("firms").alias("pos", "f")).select("title_id", "category", "pos", F.col("f.conmst").alias("key"), F.col("f.name").alias("name"))
    rows = E.apply_redirects(_numbered(rows, "title_id", "category", "pos").withColumn("norm", X.company_norm("name")), "norm", closed)
    rows, claims = upsert(known, rows, F.col("norm"))
    kind = F.coalesce(F.create_map(*[F.lit(v) for kv in COMPANY_TYPES.items() for v in kv])[F.col("category")], F.lit("misc"))
    types = rows.groupBy("entity").agg(F.min_by(kind, "ord").alias("type"))
    edges = rows.withColumn("n", F.row_number().over(Window.partitionBy("title_id", "entity").orderBy("ord"))).filter("n = 1")
    return {"title_company": edges.select("title_id", F.col("entity").alias("company_id"), F.col("category").alias("role")), "claim": claims.join(types, "entity")}


def with_claims(entities: DataFrame, claims: DataFrame, key: str) -> DataFrame:
    """entities(id, name, norm, key) and the new ones; a key that an entity has stays, a missing one is claimed."""
    c = claims.select(F.col("entity").alias("id"), F.col("key").alias("_key"), F.col("name").alias("_name"), "is_new")
    old = entities.join(c.filter("not is_new").select("id", "_key"), "id", "left").withColumn(key, F.coalesce(F.col(key), "_key")).select("id", "name", key)
    return old.unionByName(c.filter("is_new").select("id", F.trim("_name").alias("name"), F.col("_key").alias(key)))


def rollups(own: DataFrame, folded: DataFrame) -> DataFrame:
    """(person_id, roles, credit_count) over the credits of both sources, each edge once."""
    edges = own.select("title_id", "person_id", "role").unionByName(folded.select("title_id", "person_id", "role")).distinct()
    return edges.groupBy("person_id").agg(F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"), F.count(F.lit(1)).alias("credit_count"))
