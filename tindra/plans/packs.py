"""Markdown packs as ordered lines (ord, line): a funding digest, a catalog, stream briefs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import catalog as C
from ..operators import ledger as L


def _lines(*parts: DataFrame) -> DataFrame:
    """Parts (key, line) one after the other, each in the order of its key."""
    out = None
    for i, p in enumerate(parts):
        q = p.select(F.struct(F.lit(i).alias("part"), F.col("key").cast("string").alias("key")).alias("ord"), "line")
        out = q if out is None else out.unionByName(q)
    return out


def _text(df: DataFrame, *lines: str) -> DataFrame:
    return df.sparkSession.range(len(lines)).select(F.lpad(F.col("id").cast("string"), 9, "0").alias("key"), F.get(F.array(*map(F.lit, lines)), F.col("id").cast("int")).alias("line"))


def funding(awards: DataFrame, top: int = 20) -> DataFrame:
    known = awards.filter("amount is not null")
    row = lambda label: F.format_string("| %s | %d | %s |", F.col(label).cast("string"), "awards", X.isk(F.col("total").cast("bigint")))
    year = L.by(known, "year").select(F.lpad(F.col("year").cast("string"), 9, "0").alias("key"), row("year").alias("line"))
    fam = L.by(known, "family").select(F.lpad((F.lit(10**15) - F.col("total")).cast("bigint").cast("string"), 18, "0").alias("key"), row("family").alias("line"))
    best = L.top(known.filter("company is not null"), top).select(F.concat(F.lpad((F.lit(10**15) - F.col("total")).cast("bigint").cast("string"), 18, "0"), F.col("company")).alias("key"), row("company").alias("line"))
    return _lines(_text(awards, "# Funding", "", "| year | awards | total |", "|---|---|---|"), year, _text(awards, "", "| family | awards | total |", "|---|---|---|"), fam, _text(awards, "", "| recipient | awards | total |", "|---|---|---|"), best)


def _n(df: DataFrame, *order) -> DataFrame:
    """Curated rows (some dozens) with their place, as a key."""
    return df.withColumn("key", F.lpad(F.row_number().over(Window.orderBy(*order)).cast("string"), 9, "0"))


def _or_dash(name: str):
    return F.coalesce(F.nullif(F.col(name).cast("string"), F.lit("")), F.lit("—"))


STREAM_ORDER = ("family", "stage", "level", "id")


def stream_briefs(streams: DataFrame, documents: DataFrame) -> DataFrame:
    """(stream_id, text): one brief a stream: its head, purpose, rules, notes, and documents in the order of their levels."""
    place = L.rank_order("requirement", C.LEVEL_ORDER)
    level = documents.groupBy("stream_id", "requirement").agg(F.concat_ws("\n", F.concat(F.lit("*"), F.initcap("requirement"), F.lit(":*")), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: F.concat(F.lit("- "), x["text"])), "\n")).alias("part"), F.first(place).alias("o"))
    docs = level.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "part"))), lambda x: x["part"]), "\n").alias("docs"))
    line = lambda label, name: F.when(F.coalesce(F.col(name).cast("string"), F.lit("")) != "", F.concat(F.lit(f"- {label}: "), F.col(name).cast("string")))
    rules = F.array_join(F.transform(F.map_entries("rules"), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"])), "\n")
    parts = [
        F.concat(F.lit("# "), _or_dash("name_is")), F.concat(F.lit("*"), F.col("name_en"), F.lit("*")),
        line("Stream", "gatta_id"), F.concat(F.lit("- Family and stage: "), _or_dash("family"), F.lit(" · "), _or_dash("stage")), line("Format", "format_track"),
        F.concat(F.lit("- Maximum: "), X.isk("max_amount_isk")), line("Payment split", "payment_split"), line("Portal", "portal_url"), line("Confidence", "confidence"),
        F.concat(F.lit("Purpose: "), F.col("purpose")), F.concat(F.lit("Rules:\n"), F.nullif(rules, F.lit(""))), F.concat(F.lit("Notes: "), F.col("notes")),
        F.coalesce(F.concat(F.lit("Documents:\n"), F.col("docs")), F.lit("No documents listed.")),
    ]
    return streams.join(docs, streams["id"] == docs["stream_id"], "left").select(F.col("id").alias("stream_id"), F.concat_ws("\n", *parts).alias("text"))


def _stream_table(streams: DataFrame) -> tuple[DataFrame, DataFrame]:
    row = F.format_string("| %s | %s | %s | %s |", _or_dash("gatta_id"), _or_dash("name_is"), _or_dash("stage"), X.isk("max_amount_isk"))
    return _text(streams, "| key | stream | stage | maximum |", "|---|---|---|---|"), _n(streams, *STREAM_ORDER).select("key", row.alias("line"))


def _headline(awards: DataFrame, top: int) -> list[DataFrame]:
    known = awards.filter("amount is not null")
    year = L.by(known, "year").select(F.lpad(F.col("year").cast("string"), 9, "0").alias("key"), F.format_string("| %d | %d | %s |", "year", "awards", X.isk(F.col("total").cast("bigint"))).alias("line"))
    best = L.top(known.filter("company is not null"), top)
    names = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("total")).alias("o"), "company", X.isk(F.col("total").cast("bigint")).alias("t")))), lambda x: F.concat(x["company"], F.lit(" ("), x["t"], F.lit(")")))
    return [_text(awards, "| year | awards | total |", "|---|---|---|"), year, best.agg(F.concat(F.lit("Most funded: "), F.array_join(names, ", ")).alias("line")).select(F.lit("").alias("key"), "line")]


def _process(t: dict[str, DataFrame]) -> DataFrame:
    limit = F.when(F.coalesce("deadline_months", F.lit(0)) != 0, F.format_string(" (%d months)", "deadline_months")).otherwise("")
    return _n(t["process_stages"], "order").select("key", F.concat(F.format_string("%d. %s — %s", "order", "name_is", F.coalesce("condition", F.lit(""))), limit).alias("line"))


def _rebate(t: dict[str, DataFrame]) -> DataFrame:
    return t["rebate"].limit(1).select(F.lit("").alias("key"), F.format_string("- %d%% general, %d%% enhanced", "general_pct", "enhanced_pct").alias("line"))


def master(t: dict[str, DataFrame], awards: DataFrame, top: int = 6) -> DataFrame:
    """(ord, line): the digest of everything: streams, rebate, funding, process."""
    some = t["grant_streams"]
    return _lines(_text(some, "# Digest", "## Streams"), *_stream_table(some), _text(some, "## Rebate"), _rebate(t), _text(some, "## Funding"), *_headline(awards, top), _text(some, "## Process"), _process(t))


def full(t: dict[str, DataFrame], awards: DataFrame, top: int = 8) -> DataFrame:
    """(ord, line): the whole knowledge base as one text. Families without streams are left out."""
    some, fam = t["grant_streams"], t["grant_families"]
    head = _n(fam.join(some.select(F.col("family").alias("id")), "id", "left_semi"), "id").withColumnRenamed("key", "f")
    heads = head.select(F.col("f").alias("key"), F.concat(F.lit("### "), _or_dash("name_is"), F.lit(" — "), _or_dash("name_en"), F.coalesce(F.concat(F.lit("\n"), "purpose"), F.lit(""))).alias("line"))
    briefs = stream_briefs(some, t["stream_documents"]).join(_n(some, *STREAM_ORDER).select(F.col("id").alias("stream_id"), F.col("family").alias("id"), F.col("key").alias("s")), "stream_id").join(head.select("id", "f"), "id")
    streams = briefs.select(F.concat("f", F.lit("."), "s").alias("key"), F.concat(F.lit("###"), "text").alias("line"))
    spec = _n(t["documents"], "name_is", "ord").select("key", F.concat_ws("\n", F.format_string("### %s (%s)", _or_dash("name_is"), _or_dash("name_en")), F.concat(F.lit("- Purpose: "), "purpose"), F.concat(F.lit("- Must prove: "), "what_it_must_prove"), F.concat(F.lit("- Format: "), F.nullif("format_limit", F.lit("—"))), F.concat(F.lit("- File name: "), "naming_convention"), F.concat(F.lit("- Common weaknesses: "), "common_weaknesses")).alias("line"))
    crit = _n(t["criteria"], "id").select("key", F.concat_ws("\n", F.format_string("### %s (%s)", _or_dash("name_is"), _or_dash("name_en")), "description", F.concat(F.lit("- Strength: "), "evidence_examples"), F.concat(F.lit("- Red flags: "), "red_flags")).alias("line"))
    amounts = _n(t["grant_amounts"], "family", "format_track", "year").select("key", F.format_string("| %s | %s | %d | %s | %s |", "family", "format_track", "year", F.to_json("parts"), X.isk("total")).alias("line"))
    every = _lines(_text(some, "# Knowledge base", "## 1. Grants"), heads.unionByName(streams), _text(some, "## 2. Documents"), spec, _text(some, "## 3. Criteria"), crit, _text(some, "## 4. Amounts"), *_stream_table(some), _text(some, "| family | format | year | parts | total |", "|---|---|---|---|---|"), amounts, _text(some, "## 5. Rebate"), _rebate(t), _text(some, "## 6. Process"), _process(t), _text(some, "## 7. Funding"), *_headline(awards, top))
    return every.select("ord", F.posexplode(F.split("line", "\n")).alias("k", "line")).select(F.struct("ord", "k").alias("ord"), "line")


def json_pack(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, value): every row of the tables as JSON, nulls kept: the structured twin of the text."""
    out = None
    for name, df in tables.items():
        one = df.select(F.lit(name).alias("name"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def health(checks: DataFrame, coverage: DataFrame, queues: DataFrame, sources: DataFrame, drift: DataFrame) -> DataFrame:
    """(ord, line): the report of checks(metric, value, status), coverage(name, share), queues(queue, n), sources(id, files, status)
    and drift(metric, value, previous, status)."""
    every = checks.select("status").unionByName(sources.select("status")).unionByName(drift.select("status"))
    counts = every.agg(F.count_if(F.col("status") == "FAIL").alias("f"), F.count_if(F.col("status") == "WARN").alias("w")).select(F.lit("").alias("key"), F.format_string("%d failures, %d warnings", "f", "w").alias("line"))
    number = lambda x: F.call_function("format_number", F.col(x).cast("double"), F.lit("0.##"))
    return _lines(
        _text(checks, "# Data health"), counts,
        _text(checks, "## Checks"), checks.select(F.col("metric").alias("key"), F.format_string("- %s %s: %s", "status", "metric", number("value")).alias("line")),
        _text(checks, "## Coverage"), coverage.select(F.col("name").alias("key"), F.format_string("- %s: %s%%", "name", number("share")).alias("line")),
        _text(checks, "## Queues"), queues.select(F.col("queue").alias("key"), F.format_string("- %s: %d", "queue", "n").alias("line")),
        _text(checks, "## Sources"), sources.select(F.col("id").alias("key"), F.format_string("- %s %s: %d files", "status", "id", "files").alias("line")),
        _text(checks, "## Drift"), drift.select(F.col("metric").alias("key"), F.format_string("- %s %s: %s", "status", "metric", number("value")).alias("line")),
    )


def catalog(families: DataFrame, streams: DataFrame, all_families: bool = True) -> DataFrame:
    """Families with their streams below them; an export leaves out families without streams."""
    head = families.select("id", F.lpad(F.col("ord").cast("string"), 4, "0").alias("k"), F.coalesce("name_en", "name_is").alias("name"))
    if not all_families:
        head = head.join(streams.select(F.col("family").alias("id")), "id", "left_semi")
    rows = streams.select(F.col("family").alias("id"), F.col("ord").alias("s"), F.format_string("- %s (%s)", F.coalesce("name_en", "name_is"), X.isk("max_amount_isk")).alias("line")).join(head.select("id", "k"), "id")
    return _lines(head.select(F.concat("k", F.lit(".0000")).alias("key"), F.concat(F.lit("## "), "name").alias("line")).unionByName(rows.select(F.concat("k", F.lit("."), F.lpad((F.col("s") + 1).cast("string"), 4, "0")).alias("key"), "line")))
