"""Data quality: schema rules, dangling references, metrics, coverage, floors, drift, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule:
    """A named condition on one column; rows where it is false are failures. Nulls pass unless required."""

    def __init__(self, column: str, check: str, ok: Column, required: bool = False) -> None:
        self.column, self.check, self.ok, self.required = column, check, ok, required


def required(column: str) -> Rule:
    return Rule(column, "not_null", F.col(column).isNotNull(), True)


def in_range(column: str, low: float, high: float) -> Rule:
    return Rule(column, f"in_range({low}, {high})", F.col(column).try_cast("double").between(low, high))


def at_least(column: str, low: float) -> Rule:
    return Rule(column, f"ge({low})", F.col(column).try_cast("double") >= low)


def one_of(column: str, values: list) -> Rule:
    return Rule(column, "isin", F.col(column).isin(*values))


def matches(column: str, pattern: str) -> Rule:
    return Rule(column, f"matches({pattern})", F.col(column).rlike(pattern))


def min_length(column: str, n: int) -> Rule:
    return Rule(column, f"min_length({n})", F.length(column) >= n, True)


def failures(df: DataFrame, dataset: str, rules: list[Rule]) -> DataFrame:
    """All failures of all rules in one pass: (dataset, column, check, failure_case)."""
    found = [F.when((F.lit(r.required) | F.col(r.column).isNotNull()) & ~F.coalesce(r.ok, F.lit(False)), F.struct(F.lit(r.column).alias("column"), F.lit(r.check).alias("check"), F.col(r.column).cast("string").alias("failure_case"))) for r in rules]
    rows = df.select(F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("f"))
    return rows.select(F.lit(dataset).alias("dataset"), "f.*")


# What the six datasets must look like.
FAMILIES = ["handrit", "throun", "framleidsla", "eftirvinnsla", "endurgreidsla", "annad"]


def schemas() -> dict[str, list[Rule]]:
    """Rules by dataset. Numbers are tried as numbers, so a text that isn't one fails its range."""
    source = Rule("source_id", "matches(^src\\.)", F.col("source_id").rlike("^src\\."), True)
    production = [min_length("title", 1), in_range("year", 1900, 2030), Rule("source", "matches(^src\\.)", F.col("source").rlike("^src\\."), True)]
    year = in_range("year", 2018, 2026)
    return {
        "allocations": [min_length("project_title", 1), Rule("year", year.check, year.ok, True), at_least("amount_isk", 0), at_least("commitment_isk", 0), one_of("family", FAMILIES), source],
        "productions_films": production,
        "productions_series": production,
        "companies_producers": [min_length("name", 1), Rule("is_sik_member", "isin", F.col("is_sik_member").try_cast("int").isin(0, 1), True)],
        "lexicon": [min_length("is", 1), min_length("en", 1), min_length("category", 1)],
        "imdb_links": [Rule("imdb_tconst", "matches(^tt\\d+$)", F.col("imdb_tconst").rlike("^tt\\d+$"), True), min_length("title_norm", 1), in_range("year", 1900, 2030)],
    }


def gate(datasets: dict[str, DataFrame]) -> DataFrame:
    """All failures of the datasets that are there; none that is there may be unknown."""
    rules, out = schemas(), None
    for name, df in datasets.items():
        one = failures(df, name, rules[name])
        out = one if out is None else out.unionByName(one)
    return out


def queues(flags: DataFrame, candidates: DataFrame, decisions: DataFrame, aliases: DataFrame, parked: DataFrame, awards: DataFrame) -> DataFrame:
    """(queue, n): what waits for people, and what they have decided. candidates(kind), decisions(kind, decision)."""

    def counted(df: DataFrame, **named: Column) -> DataFrame:
        return df.agg(*[F.count_if(c).alias(k.replace("_", " ")) for k, c in named.items()]).unpivot([], [k.replace("_", " ") for k in named], "queue", "n")

    kind = lambda k: F.col("kind") == k
    is_ = lambda k, d: (F.col("kind") == k) & (F.col("decision") == d)
    parts = [
        counted(flags, open_flags=F.col("status") == "open"),
        counted(candidates, company_candidates=kind("company"), person_candidates=kind("person")),
        counted(decisions, company_merged=is_("company", "merged"), person_merged=is_("person", "merged"), company_rejected=is_("company", "rejected"), person_rejected=is_("person", "rejected")),
        counted(aliases, unresolved_aliases=F.col("status") == "unresolved"),
        counted(parked, parked_links=F.lit(True)),
        counted(awards, awards_without_amount=F.col("amount_isk").isNull()),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class DanglingReference(ValueError):
    pass


def dangling(df: DataFrame, refs: Column, known: DataFrame, key: str) -> DataFrame:
    """References that aren't in known(key)."""
    asked = df.select(F.explode(refs).alias(key)) if refs is not None else df
    return asked.join(known.select(key), key, "left_anti").distinct()


def insist(df: DataFrame) -> None:
    """Fail the build, with examples, before anything is written."""
    if rows := df.limit(5).collect():
        raise DanglingReference(", ".join(str(r[0]) for r in rows))


def metrics(df: DataFrame, named: dict[str, Column]) -> DataFrame:
    """(metric, value) of several aggregates in one pass."""
    one = df.agg(*[v.cast("double").alias(k) for k, v in named.items()])
    return one.unpivot([], list(named), "metric", "value").withColumn("value", F.coalesce("value", F.lit(0.0)))


def share(a, b) -> Column:
    return F.bround(100 * a / F.greatest(b, F.lit(1)), 1)


def verdicts(values: DataFrame, floors: dict[str, tuple[str, float, str]]) -> DataFrame:
    """floors: metric -> (operator, bound, level on failure). (metric, value, status)."""
    tests = {"=": lambda v, b: v == b, ">=": lambda v, b: v >= b, ">": lambda v, b: v > b}
    status = F.coalesce(*[F.when(F.col("metric") == m, F.when(tests[op](F.coalesce("value", F.lit(0.0)), F.lit(float(b))), "OK").otherwise(level)) for m, (op, b, level) in floors.items()])
    return values.withColumn("status", status).filter("status is not null")


# The knowledge base's floors.
FLOORS = {"grant_families": ("=", 6, "FAIL"), "grant_streams": (">=", 20, "FAIL"), "allocations": (">=", 790, "FAIL"), "doc_key_match_pct": (">=", 90, "WARN"), "title": (">=", 900, "FAIL"), "title_credit": (">", 0, "FAIL"), "person": (">", 0, "FAIL"), "adm_over_500k": ("=", 0, "FAIL"), "corpus_article": (">", 0, "WARN")}


def drift(now: DataFrame, before: DataFrame, least: float = 0.10) -> DataFrame:
    """Metrics that moved by a tenth or more, and new ones; a fall warns. A previous zero is no base."""
    rows = now.select("metric", "value").join(before.select("metric", F.col("value").alias("previous")), "metric", "left")
    moved = (F.col("previous") != 0) & (F.abs(F.col("value") - F.col("previous")) / F.greatest(F.lit(1.0), F.col("previous")) >= least)
    return rows.filter(F.col("previous").isNull() | moved).withColumn("status", F.when(F.col("value") < F.col("previous"), "WARN").otherwise("OK"))


FLAGS = ("wrong", "missing", "review")


def flag(spark, target_type: str, target_id, label: str, kind: str, note: str = "", user: str = "") -> DataFrame:
    """One open flag as a row; an unknown kind is an error."""
    if kind not in FLAGS:
        raise ValueError(f"flag must be one of {', '.join(FLAGS)}")
    return spark.range(1).select(F.concat_ws("-", F.date_format(F.current_timestamp(), "yyyyMMdd'T'HHmmss"), F.left(F.replace(F.uuid(), F.lit("-"), F.lit("")), F.lit(6))).alias("id"), F.lit(user).alias("user"), F.lit(target_type).alias("target_type"), F.lit(str(target_id)).alias("target_id"), F.lit(label).alias("target_label"), F.lit(kind).alias("flag"), F.lit(note).alias("note"), F.lit("open").alias("status"))


def flag_summary(flags: DataFrame) -> DataFrame:
    """Per type: all flags and the open ones."""
    return flags.groupBy("target_type").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "open").alias("open"))


def source_health(sources: DataFrame, files: DataFrame) -> DataFrame:
    """sources(id, local_path) against a listing (path): how many files lie at or under each path."""
    f = files.select(F.col("path").alias("p"))
    steps = f.select("p", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("p", "/"))), lambda k: F.array_join(F.slice(F.split("p", "/"), 1, k), "/"))).alias("local_path"))
    n = steps.groupBy("local_path").agg(F.count(F.lit(1)).alias("files"))
    rows = sources.filter("local_path is not null").withColumn("local_path", F.regexp_replace("local_path", "/+$", ""))
    return rows.join(n, "local_path", "left").select("id", "local_path", F.coalesce("files", F.lit(0)).alias("files"), F.when(F.col("files") > 0, "OK").otherwise("WARN").alias("status"))
