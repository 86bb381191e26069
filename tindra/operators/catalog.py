"""The grant catalog from curated collections: families, streams, their documents, amounts; provenance is checked first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.tables import META
from . import quality as Q

# Requirement levels and the order in which they are shown.
LEVELS = {"required": "required", "recommended": "recommended", "strategic": "strategic", "newcomer_extra": "newcomer", "optional": "optional"}
LEVEL_ORDER = ["required", "newcomer", "recommended", "strategic", "optional"]


def provenance(collections: dict[str, DataFrame], sources: DataFrame) -> dict[str, DataFrame]:
    """dangling source ids (which must be none), and records without sources or confidence (warnings)."""
    refs = warn = None
    for name, df in collections.items():
        r = df.select(F.lit(name).alias("collection"), F.col("id").cast("string").alias("record"), F.explode_outer("_meta.sources").alias("id")).filter("id is not null")
        w = df.filter(F.col("_meta.sources").isNull() | (F.size("_meta.sources") == 0) | F.col("_meta.confidence").isNull()).select(F.lit(name).alias("collection"), F.col("id").cast("string").alias("record"))
        refs, warn = (r, w) if refs is None else (refs.unionByName(r), warn.unionByName(w))
    return {"dangling": refs.join(sources.select("id"), "id", "left_anti").select("id", "collection", "record"), "warnings": warn}


def match_documents(texts: DataFrame, specs: DataFrame) -> DataFrame:
    """texts(id, text): the document spec whose longest alias or name the text holds, in any case; ties to the earlier one.

    Specs are a curated list of some dozens, so each text is held against an array of all of them in place, not joined.
    """
    names = specs.select("doc_key", "ord", F.explode(F.concat(F.array("name_is", "name_en"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias")).filter("alias is not null and alias != ''")
    best = names.agg(F.array_sort(F.collect_list(F.struct((-F.length("alias")).alias("n"), "ord", F.lower("alias").alias("alias"), "doc_key"))).alias("names"))
    hit = F.filter("names", lambda a: F.lower(F.col("text")).contains(a["alias"]))
    return texts.crossJoin(F.broadcast(best)).select("id", F.get(hit, F.lit(0))["doc_key"].alias("doc_key"))


def stream_documents(streams: DataFrame, specs: DataFrame) -> DataFrame:
    """One row per required document of each stream, in order, with its spec where one matches."""
    level = F.create_map(*[F.lit(v) for kv in LEVELS.items() for v in kv])
    rows = streams.select(F.col("id").alias("stream_id"), F.explode("documents").alias("key", "texts")).select("stream_id", "key", F.posexplode("texts").alias("pos", "text"))
    rows = rows.withColumn("requirement", F.coalesce(level[F.col("key")], F.col("key"))).withColumn("id", F.concat_ws("|", "stream_id", "key", F.col("pos").cast("string")))
    return rows.join(match_documents(rows.select("id", "text"), specs), "id").select("stream_id", "requirement", "pos", "text", "doc_key")


def with_default(df: DataFrame, meta: dict | None) -> DataFrame:
    """Records without _meta get the default of their file."""
    if not meta:
        return df
    one = F.struct(*[(F.array(*map(F.lit, meta.get(k) or [])).cast("array<string>") if k == "sources" else F.lit(meta.get(k)).cast("string")).alias(k) for k in ("sources", "confidence", "checked_at", "notes")]).cast(META)
    return df.withColumn("_meta", F.coalesce("_meta", one))


def rebate(doc: DataFrame) -> dict[str, DataFrame]:
    """The one rebate record and its stages."""
    one = doc.select("id", "name_is", "name_en", "rates.*", "producer_strategy.*", F.col("_meta.confidence").alias("confidence"))
    stage = doc.select(F.col("id").alias("rebate_id"), F.explode("stages").alias("s")).select("rebate_id", F.col("s.order").alias("ord"), "s.id", "s.name_is", "s.description", "s.stream_id")
    return {"rebate": one, "rebate_stages": stage}


def build(raw: dict[str, DataFrame], default_meta: dict | None = None, portal: str | None = None) -> dict[str, DataFrame]:
    """Catalog tables; raises before anything is built if a source id dangles. portal: a url pattern for streams without a url."""
    raw = {**raw, "grant_streams": with_default(raw["grant_streams"], default_meta)}
    held = {k: raw[k].select("id", "_meta") for k in ("grant_families", "grant_streams", "rebate") if k in raw}
    if "process" in raw:
        held["process"] = raw["process"].select(F.inline(F.array(*[F.struct(F.col(f"{k}.id").alias("id"), F.col(f"{k}._meta").alias("_meta")) for k in ("contract_process", "film_archive_deposit")])))
    found = provenance(held, raw["sources"])
    Q.insist(found["dangling"])
    streams = raw["grant_streams"].withColumn("confidence", F.col("_meta.confidence"))
    if portal:
        streams = streams.withColumn("portal_url", X.portal_url("portal_url", "gatta_id", portal))
    out = {
        "sources": raw["sources"],
        "grant_families": raw["grant_families"].drop("_meta"),
        "grant_streams": streams.drop("documents", "_meta"),
        "stream_documents": stream_documents(raw["grant_streams"], raw["documents"]),
        "documents": raw["documents"],
        "criteria": raw["criteria"],
        "grant_amounts": raw["grant_amounts"],
        "warnings": found["warnings"],
    }
    if "rebate" in raw:
        out |= rebate(raw["rebate"])
    if "process" in raw:
        out |= process(raw["process"])
    return out


def process(doc: DataFrame) -> dict[str, DataFrame]:
    """Stages of the contract process with their checklists and forms, and the links of the archive deposit (one JSON document)."""
    stage = doc.select(F.explode("contract_process.stages").alias("s")).select("s.*")
    return {
        "film_archive_links": doc.select(F.col("film_archive_deposit.id").alias("deposit_id"), F.explode("film_archive_deposit.links").alias("link_key", "url")),
        "process_stages": stage.select("order", "id", "name_is", "condition", "deadline_months"),
        "process_checklist": stage.select(F.col("id").alias("stage_id"), F.posexplode("checklist").alias("ord", "c")).select("stage_id", "ord", "c.*"),
        "process_forms": stage.select(F.col("id").alias("stage_id"), F.posexplode("forms").alias("ord", "f")).select("stage_id", "ord", "f.*"),
    }
