"""Chunks of the seven kinds of records that retrieval searches: (id, text, metadata), all as projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# The sentence of each kind of record.
STREAM = "%s (%s) — %s/%s. Markmið: %s. Hámarksupphæð: %s. Greiðsluskipting: %s. %sSkylt fylgigögn: %s."
REBATE = "Endurgreiðslukerfi: %s%% almennt (%s), %s%% sérstakt (%s). %s"
STAGE = "Samningsferli – %s: %s %s"
DOCUMENT = "Skjal/fylgigagn: %s (%s). Tilgangur: %s Á að sanna: %s Snið/lengd: %s. Skráarnafn: %s. Algeng mistök: %s"
CRITERION = "Matsþáttur ráðgjafa: %s (%s). %s Styrkleikamerki: %s Rauð flögg: %s"
AWARD = "%s (%s) — %s %s. Framleiðandi: %s. Leikstjóri: %s. Handritshöfundur: %s. Styrkur: %s ISK."


def _shown(name: str) -> Column:
    """A field as it is printed: a missing one is the word None."""
    return F.coalesce(F.col(name).cast("string"), F.lit("None"))


def _or(name: str, other: str) -> Column:
    """A field, or something else where it is missing, empty or zero."""
    v = F.col(name).cast("string")
    return F.when(F.coalesce(v, F.lit("")).isin("", "0"), other).otherwise(v)


def _meta(**fields) -> Column:
    pairs = [x for k, v in fields.items() for x in (F.lit(k), v.cast("string") if isinstance(v, Column) else F.lit(v))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()).alias("metadata")


def streams(grants: DataFrame, documents: DataFrame) -> DataFrame:
    """Grant streams with the documents that they require, in order."""
    need = documents.filter("requirement = 'required'").groupBy(F.col("stream_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), ", ").alias("need"))
    rules = F.array_join(F.transform(F.map_entries("rules"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
    shown = F.when(F.coalesce(rules, F.lit("")) != "", F.concat(F.lit("Skilyrði: "), rules, F.lit(". "))).otherwise("")
    text = F.format_string(STREAM, _shown("name_is"), _shown("gatta_id"), _shown("family"), _shown("stage"), _or("purpose", ""), _or("max_amount_isk", "óþekkt"), _or("payment_split", "—"), shown, F.coalesce("need", F.lit("")))
    return grants.join(need, "id", "left").select(F.concat(F.lit("stream:"), "id").alias("id"), text.alias("text"), _meta(type="grant_stream", gatta_id=F.col("gatta_id"), family=F.col("family"), stage=F.col("stage"), confidence=F.col("confidence")))


def rebate(df: DataFrame) -> DataFrame:
    text = F.format_string(REBATE, _shown("general_pct"), _shown("general_basis"), _shown("enhanced_pct"), _shown("enhanced_conditions"), _shown("regla_18_manuda"))
    return df.limit(1).select(F.lit("rebate").alias("id"), text.alias("text"), _meta(type="rebate", confidence=F.col("confidence")))


def stages(df: DataFrame) -> DataFrame:
    limit = F.when(F.coalesce("deadline_months", F.lit(0)) != 0, F.format_string("Frestur: %d mán.", "deadline_months")).otherwise("")
    return df.select(F.concat(F.lit("process:"), "id").alias("id"), F.format_string(STAGE, _shown("name_is"), _or("condition", ""), limit).alias("text"), _meta(type="process_stage"))


def documents(df: DataFrame) -> DataFrame:
    names = ("name_is", "name_en", "purpose", "what_it_must_prove", "format_limit", "naming_convention", "common_weaknesses")
    return df.select(F.concat(F.lit("doc:"), "doc_key").alias("id"), F.format_string(DOCUMENT, *map(_shown, names)).alias("text"), _meta(type="document", doc_key=F.col("doc_key")))


def criteria(df: DataFrame) -> DataFrame:
    names = ("name_is", "name_en", "description", "evidence_examples", "red_flags")
    return df.select(F.concat(F.lit("criterion:"), "id").alias("id"), F.format_string(CRITERION, *map(_shown, names)).alias("text"), _meta(type="criterion", id=F.col("id")))


def articles(df: DataFrame) -> DataFrame:
    """Bodies in pieces; the first one carries the title."""
    parts = df.filter("trim(body) != ''").select("id", "source", "title", "category", "date", F.posexplode(X.chunks("body")).alias("n", "part"))
    text = F.when(F.col("n") == 0, F.concat(_shown("title"), F.lit(". "), "part")).otherwise(F.col("part"))
    key = F.col("id").cast("string")
    return parts.select(F.concat_ws(":", F.lit("corpus"), key, F.col("n").cast("string")).alias("id"), text.alias("text"), _meta(type="corpus", source=F.col("source"), article_id=key, category=F.col("category"), date=F.col("date"), title=F.col("title")))


def awards(df: DataFrame) -> DataFrame:
    """One chunk an award with an amount."""
    who = F.when(F.coalesce("company", F.lit("")) != "", F.col("company")).otherwise(_or("applicant", "—"))
    text = F.format_string(AWARD, _shown("project_title"), _shown("year"), _shown("family"), _or("format_track", ""), who, _or("director", "—"), _or("writer", "—"), F.format_number("amount_isk", 0))
    meta = _meta(type="allocation", **{c: F.col(c) for c in ("year", "family", "format_track", "company", "amount_isk", "confidence")})
    return df.filter("amount_isk is not null").select(F.concat(F.lit("alloc:"), F.col("id").cast("string")).alias("id"), text.alias("text"), meta)


def build(t: dict[str, DataFrame]) -> DataFrame:
    """All chunks of the tables that are there."""
    made = []
    if "grant_streams" in t:
        made.append(streams(t["grant_streams"], t["stream_documents"]))
    kinds = {"rebate": rebate, "process_stages": stages, "documents": documents, "criteria": criteria, "corpus_article": articles, "allocations": awards}
    made += [make(t[name]) for name, make in kinds.items() if name in t]
    out = made[0]
    for one in made[1:]:
        out = out.unionByName(one)
    return out
