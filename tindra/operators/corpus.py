"""Corpus facts: tables and headlines of articles become fact rows, tied to titles and people where their names resolve."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.scratch import keep
from . import entities as E
from . import parsers as P


def resolve_titles(mentions: DataFrame, titles: DataFrame) -> DataFrame:
    """mentions(m, raw) -> (m, title_id): the equal norm, else containment of 5 characters or more; the smallest id of each.
    Each text is folded and resolved once, however many mentions it has."""
    raws = keep(mentions.sparkSession, mentions.select("raw").distinct().withColumn("ln", X.name_norm("raw")).filter("ln != ''"), "raws")
    first = titles.groupBy(F.col("norm").alias("rn")).agg(F.min("id").alias("r"))
    best = E.contained(raws, first).join(first, "rn").groupBy("ln").agg(F.min(F.struct((~F.col("exact")).alias("loose"), "r")).alias("b"))
    return mentions.select("m", "raw").join(raws.join(best, "ln").select("raw", F.col("b.r").alias("title_id")), "raw", "left").select("m", "title_id")


def resolve_people(mentions: DataFrame, people: DataFrame) -> DataFrame:
    """mentions(m, names array) -> (m, person_id): the first candidate whose norm is known."""
    c = mentions.select("m", F.posexplode("names").alias("pos", "name")).withColumn("norm", X.name_norm("name"))
    hits = c.join(people.select(F.col("id").alias("person_id"), "norm"), "norm")
    return mentions.select("m").join(hits.groupBy("m").agg(F.min_by("person_id", "pos").alias("person_id")), "m", "left")


def facts(articles: DataFrame, titles: DataFrame, people: DataFrame) -> dict[str, DataFrame]:
    """articles(id, title, html, category) -> admissions, viewership, review and award facts, and all mentions."""
    doc = articles.withColumnRenamed("id", "doc")

    def tied(rows, raw):
        keyed = rows.withColumn("m", F.concat_ws(":", F.col("doc").cast("string"), F.col("t").cast("string"), F.col("r").cast("string")))
        return keyed.join(resolve_titles(keyed.select("m", F.col(raw).alias("raw")), titles), "m", "left").drop("m", "t", "r").withColumnRenamed("doc", "article_id")

    adm = P.admissions_tables(doc.filter("category = 'box_office'")).filter(~X.is_junk_row("film")).join(doc.select("doc", X.market_scope("title").alias("scope")), "doc")
    view = P.viewership_tables(doc.filter("category = 'viewership'")).filter(~X.is_junk_row("title"))
    heads = doc.filter("category in ('review', 'award')").select("doc", "category", "title", F.get(X.headline_subjects("title"), F.lit(0)).alias("raw"))
    on_title = resolve_titles(heads.select(F.col("doc").alias("m"), "raw"), titles).withColumnRenamed("m", "doc")
    on_person = resolve_people(heads.select(F.col("doc").alias("m"), X.name_candidates("title").alias("names")), people).withColumnRenamed("m", "doc")
    heads = heads.join(on_title, "doc", "left").join(on_person, "doc", "left").withColumnRenamed("doc", "article_id")
    out = {
        "lx_admissions": tied(adm, "film"),
        "lx_viewership": tied(view, "title"),
        "lx_review": heads.filter("category = 'review'").select("article_id", "title_id", X.review_outlet("title").alias("outlet"), F.col("raw").alias("subject")),
        "lx_award": heads.filter("category = 'award'").select("article_id", "title_id", "person_id", X.award_word("title").alias("award"), F.col("raw").alias("subject")),
    }
    mention = None
    for name, kind, key in (("lx_admissions", "title", "title_id"), ("lx_viewership", "title", "title_id"), ("lx_review", "title", "title_id"), ("lx_award", "title", "title_id"), ("lx_award", "person", "person_id")):
        part = out[name].filter(F.col(key).isNotNull()).select("article_id", F.lit(kind).alias("entity_type"), F.col(key).alias("entity_id"))
        mention = part if mention is None else mention.unionByName(part)
    out["corpus_mention"] = mention.distinct()
    return out
