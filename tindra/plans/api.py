"""Query surfaces over the knowledge base's tables (a mapping of frames, each looked up only where it is read): functions return frames and don't collect."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import catalog as C
from ..operators import graph as G
from ..operators import ledger as L
from ..sources.tables import equals_if

Tables = Mapping[str, DataFrame]
# Older names of the ledger match states that callers may still use.
OLD_STATES = {"yes": "matched", "no": "no_record_in_window", "likely_unfunded": "no_record_in_window", "unknown": "before_window", "ledger_gap": "before_window"}


def list_grants(t: Tables, family: str = "") -> DataFrame:
    return t["grant_streams"].filter(equals_if("family", family)).orderBy("family", "stage", "level", "id")


def get_grant(t: Tables, key: str) -> dict[str, DataFrame]:
    """A stream by its id in any case, else the first whose name holds the key; and its documents with their specs."""
    s = t["grant_streams"]
    hit = s.filter((F.lower("gatta_id") == key.lower()) | (F.lower("id") == key.lower()) | F.col("name_is").ilike(f"%{key}%"))
    exact = ((F.lower("gatta_id") == key.lower()) | (F.lower("id") == key.lower())).cast("int")
    one = hit.orderBy(F.desc_nulls_last(exact), "ord").limit(1)
    docs = t["stream_documents"].join(one.select(F.col("id").alias("stream_id")), "stream_id", "left_semi")
    spec = t["documents"].select("doc_key", "purpose", "what_it_must_prove")
    return {"grant": one, "documents": docs.join(spec, "doc_key", "left").orderBy(L.rank_order("requirement", C.LEVEL_ORDER), "pos")}


def get_document_spec(t: Tables, key: str) -> DataFrame:
    like = f"%{key}%"
    return t["documents"].filter((F.col("doc_key") == key) | F.col("name_is").ilike(like) | F.col("name_en").ilike(like)).orderBy("ord").limit(1)


def funding_stats(t: Tables, family: str = "", year: int = 0, company: str = "") -> dict[str, DataFrame]:
    return L.funding_stats(_awards(t), family, year, company)


def top_recipients(t: Tables, n: int = 10, family: str = "") -> DataFrame:
    return L.top(_awards(t).filter(L.having(family) & F.col("company").isNotNull()), n)


def _awards(t: Tables) -> DataFrame:
    return t["allocations"].withColumn("amount", F.col("amount_isk"))


def lookup_person(t: Tables, name: str) -> dict[str, DataFrame]:
    """The busiest person whose name holds the text, without regard to case or accents; films and collaborators."""
    one = t["person"].filter(X.fold_like("name", name)).orderBy(F.desc("credit_count"), "id").limit(1)
    ids = one.select(F.col("id").alias("person_id"))
    credits = t["title_credit"]
    mine = credits.join(F.broadcast(ids), "person_id", "left_semi")
    films = mine.join(t["title"].select(F.col("id").alias("title_id"), "title", "year"), "title_id").select("title", "year", "role").orderBy(F.desc("year"), "title", "role")
    others = credits.join(mine.select("title_id"), "title_id").join(F.broadcast(ids), "person_id", "left_anti")
    best = others.groupBy("person_id").agg(F.count(F.lit(1)).alias("n")).join(t["person"].select(F.col("id").alias("person_id"), "name"), "person_id").orderBy(F.desc("n"), "name").limit(8)
    return {"person": one, "filmography": films, "collaborators": best.select("name", "n")}


def lookup_company(t: Tables, name: str) -> dict[str, DataFrame]:
    """The best funded company whose name holds the text; its projects through its resolved aliases; open candidates."""
    one = t["company"].filter(F.col("name").ilike(f"%{name}%")).orderBy(F.desc("total"), "id").limit(1)
    alias = t["company_alias"].join(F.broadcast(one.select(F.col("id").alias("company_id"))), "company_id", "left_semi")
    names = alias.filter("status = 'resolved'").select(F.col("name").alias("company"))
    projects = t["allocations"].join(names, "company", "left_semi").select("project_title", "year", "family", "amount_isk").distinct().orderBy(F.desc("year"), F.desc("amount_isk"), "project_title")
    return {"company": one, "projects": projects, "candidates": alias.filter("status = 'unresolved'").select("name", "method")}


def get_rebate(t: Tables) -> DataFrame:
    return t["rebate"].limit(1)


def productions(t: Tables, funded: str = "", kind: str = "", min_year: int = 0, limit: int = 50) -> DataFrame:
    state = OLD_STATES.get(funded, funded)
    least = F.col("year") >= min_year if min_year else F.lit(True)
    return t["title"].filter(equals_if("status", state) & equals_if("kind", kind) & least).orderBy(F.desc("year"), "title", "id").limit(limit)


def person_dossier(t: Tables, person_id: int) -> dict[str, DataFrame]:
    """Roles, projects a year, collaborators by common titles, and awards that name the person in any field."""
    person = t["person"].filter(F.col("id") == person_id)
    credits = t["title_credit"].select(F.col("title_id").alias("title"), F.col("person_id").alias("person"), "role")
    mine = credits.filter(F.col("person") == person_id)
    years = mine.join(t["title"].select(F.col("id").alias("title"), "year"), "title")
    norm = person.select(F.explode(F.array(X.loose_norm("name"), F.col("norm"))).alias("n")).filter("length(n) > 4").distinct()
    fields = t["allocations"].select("row", "project_title", "year", "family", "amount_isk", F.explode(F.array(*[F.struct(F.lit(r).alias("role"), X.dossier_names(r).alias("names")) for r in ("writer", "director", "producer", "company")])).alias("f"))
    named = fields.select("row", "project_title", "year", "family", "amount_isk", F.col("f.role").alias("role"), F.explode("f.names").alias("n")).join(F.broadcast(norm), "n", "left_semi")
    order = {r: i for i, r in enumerate(("writer", "director", "producer", "company"))}
    roles = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(F.create_map(*[F.lit(v) for kv in order.items() for v in kv])[F.col("role")].alias("o"), "role"))), lambda x: x["role"]), "/")
    awards = named.groupBy("row", "project_title", "year", "family", "amount_isk").agg(roles.alias("as")).orderBy("year", F.desc("amount_isk"))
    return {
        "person": person,
        "roles": mine.groupBy("role").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "role"),
        "pace": years.agg(F.countDistinct("title").alias("titles"), F.bround(F.countDistinct("title") / (F.max("year") - F.min("year") + 1), 2).alias("per_year")),
        "collaborators": G.collaborators(credits, person_id),
        "awards": awards,
        "award_totals": awards.agg(F.count(F.lit(1)).alias("awards"), F.countDistinct("project_title").alias("projects"), F.sum("amount_isk").alias("total"), F.min("year").alias("first_year"), F.max("year").alias("last_year")),
    }


def title_funding(t: Tables, title_id: int) -> DataFrame:
    """The awards of one title with who got them, in the order of stages."""
    a = t["award"].filter(F.col("title_id") == title_id).join(t["allocations"].select("row", "company", "writer", "producer"), "row", "left")
    stages = ["handrit", "throun", "framleidsla", "eftirvinnsla", "annad"]
    who = F.coalesce("company", "writer", "producer", F.lit("—"))
    return a.select("year", "family", "amount", who.alias("recipient")).orderBy("year", L.rank_order("family", stages))


def production_profile(t: Tables, title_id: int) -> dict[str, DataFrame]:
    """One title: its funding, credits by name, companies, other names."""
    return {
        "title": t["title"].filter(F.col("id") == title_id),
        "funding": title_funding(t, title_id),
        "credits": t["title_credit"].filter(F.col("title_id") == title_id).join(t["person"].select(F.col("id").alias("person_id"), "name"), "person_id").select("role", "name").orderBy("role", "name"),
        "companies": t["title_company"].filter(F.col("title_id") == title_id).join(t["company"].select(F.col("id").alias("company_id"), "name"), "company_id").select("name").orderBy("name"),
        "aliases": t["title_alias"].filter(F.col("title_id") == title_id).select("alias", "method").distinct(),
    }


def browse(t: Tables, words: str = "", kinds: list[str] | None = None) -> DataFrame:
    out = t["title"].filter(F.coalesce("title", F.lit("")).rlike(f"(?iu){words}") if words else F.lit(True))
    return out.filter(F.col("kind").isin(kinds)) if kinds else out


def overview(t: Tables) -> DataFrame:
    """(metric, value) of the first page: awards, their total, titles, people, companies."""
    a = t["allocations"].agg(L.awards(t["allocations"]).cast("double").alias("awards"), F.coalesce(F.sum("amount_isk"), F.lit(0)).cast("double").alias("total")).unpivot([], ["awards", "total"], "metric", "value")
    for metric, name in (("titles", "title"), ("people", "person"), ("companies", "company")):
        a = a.unionByName(t[name].agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(metric).alias("metric"), "value"))
    return a


def explore_awards(t: Tables, families: list[str] | None = None, years: list[int] | None = None, words: str = "") -> DataFrame:
    """The funding page: awards of some families and years whose title or company matches a pattern in any case, largest first."""
    a = t["allocations"]
    if families:
        a = a.filter(F.col("family").isin(families))
    if years:
        a = a.filter(F.col("year").isin(years))
    if words:
        a = a.filter(F.concat_ws(" ", "project_title", "company").rlike(f"(?iu){words}"))
    return a.select("project_title", "company", "year", "family", "amount_isk").orderBy(F.desc("amount_isk"), "project_title")


def find_names(t: Tables, table: str, words: str) -> DataFrame:
    """The people and companies page: names that hold a text, without regard to case or accents."""
    return t[table].filter(X.fold_like("name", words)).orderBy("name", "id")


def dossier_markdown(d: dict[str, DataFrame]) -> DataFrame:
    """(n, line): a person's dossier as text. One person's rows are few; they are numbered in one window."""
    name = d["person"].select(F.lit(0).alias("part"), F.lit("").alias("key"), F.concat(F.lit("# "), "name").alias("line"))
    roles = d["roles"].select(F.lit(2).alias("part"), F.concat(F.lpad((F.lit(10**6) - F.col("n")).cast("string"), 9, "0"), "role").alias("key"), F.format_string("- %s: %d", "role", "n").alias("line"))
    row = F.format_string("| %d | %s | %s | %s |", "year", "project_title", "as", X.isk("amount_isk"))
    awards = d["awards"].select(F.lit(5).alias("part"), F.concat(F.lpad(F.col("year").cast("string"), 6, "0"), F.lpad((F.lit(10**15) - F.coalesce("amount_isk", F.lit(0))).cast("string"), 18, "0"), "project_title").alias("key"), row.alias("line"))
    fixed = [(1, ""), (3, ""), (4, "| year | project | as | amount |\n|---|---|---|---|")]
    text = name.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(p).alias("part"), F.lit("").alias("key"), F.lit(x).alias("line")) for p, x in fixed])))
    every = name.unionByName(roles).unionByName(awards).unionByName(text).select("part", "key", F.posexplode(F.split("line", "\n")).alias("k", "line"))
    return every.select((F.row_number().over(Window.orderBy("part", "key", "k")) - 1).cast("long").alias("n"), "line")


class NotReadOnly(ValueError):
    pass


# Functions that an ad-hoc query may call. Functions that run code, read files, ask the session or wait aren't among
# them, nor is any that Spark may get later.
ALLOWED = set("""
abs acos array array_contains array_distinct array_join array_max array_min array_position array_size array_sort array_union arrays_overlap
asin atan avg bool_and bool_or bround cast ceil ceiling char_length coalesce collect_list collect_set concat concat_ws contains cos count
count_if cume_dist current_date date_add date_diff date_format date_sub date_trunc datediff day dayofmonth dayofweek dayofyear dense_rank
element_at endswith every exists exp explode explode_outer first first_value flatten floor format_number format_string from_json get
get_json_object greatest hour if ifnull in initcap instr isnotnull isnull lag last last_value lcase lead least left length like ln locate log
log10 log2 lower lpad ltrim make_date map map_keys map_values max max_by mean median md5 min min_by minute mod month nth_value ntile nullif
nvl nvl2 percent_rank percentile percentile_approx position posexplode pow power quarter rank regexp_count regexp_extract
regexp_extract_all regexp_like regexp_replace replace reverse right rlike round row_number rpad rtrim second sha2 sign sin size slice some
sort_array split split_part sqrt startswith std stddev stddev_pop stddev_samp string struct substr substring sum tan to_date to_json
to_timestamp transform translate trim try_cast try_divide try_element_at ucase upper var_pop var_samp variance weekofyear width_bucket
year and or not when between bigint int integer smallint tinyint double float decimal date timestamp boolean array_agg string_agg listagg
""".split())


def select_only(sql: str) -> str:
    """The statement if it is one that starts as a query; anything else is refused."""
    one = sql.strip().rstrip(";").strip()
    if ";" in one:
        raise NotReadOnly("one statement at a time")
    if not re.match(r"(?is)(select|with)\b", one):
        raise NotReadOnly("only SELECT or WITH")
    return one


def _insist_on_query(spark: SparkSession, sql: str, known: set[str]) -> set[str]:
    """Look at the parsed plan: no commands anywhere, and no relation but those known and the statement's own CTEs. Returns the
    names of the known ones that it reads."""
    todo, own, asked = [spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)], set(), []
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedWith":
            each = node.cteRelations()
            for i in range(each.size()):
                own.add(each.apply(i)._1().lower())
                todo.append(each.apply(i)._2())
        elif kind == "UnresolvedRelation":
            parts = node.multipartIdentifier()
            asked.append([parts.apply(i).lower() for i in range(parts.size())])
        elif re.search("Insert|Command|Create|Drop|Delete|Update|Merge|Statement|Write|Set|Load|Cache", kind) and kind not in ("SetOperation",):
            raise NotReadOnly(f"{kind} is no query")
        for step in (node.children(), node.innerChildren()):
            for i in range(step.size()):
                child = step.apply(i)
                if hasattr(child, "multipartIdentifier") or "plans.logical" in child.getClass().getName() or "analysis" in child.getClass().getName():
                    todo.append(child)
        for e in _subqueries(node):
            todo.append(e)
        _insist_on_functions(node)
    for parts in asked:
        if len(parts) != 1 or parts[0] not in known | own:
            raise NotReadOnly(f"{'.'.join(parts)} isn't one of the tables")
    return {parts[0] for parts in asked} & known


def _insist_on_functions(node) -> None:
    """Every function that the node's expressions call by name is among those allowed."""
    todo = [node.expressions().apply(i) for i in range(node.expressions().size())]
    if node.getClass().getSimpleName() in ("UnresolvedTableValuedFunction", "UnresolvedTVFAliases"):
        raise NotReadOnly("table functions aren't allowed")
    while todo:
        e = todo.pop()
        if e.getClass().getSimpleName() == "UnresolvedFunction":
            parts = e.nameParts()
            name = ".".join(parts.apply(i) for i in range(parts.size())).lower()
            if name not in ALLOWED:
                raise NotReadOnly(f"the function {name} isn't allowed")
        todo += [e.children().apply(i) for i in range(e.children().size())]


def _subqueries(node) -> list:
    found, todo = [], [node.expressions().apply(i) for i in range(node.expressions().size())]
    while todo:
        e = todo.pop()
        if e.getClass().getSimpleName() in ("ScalarSubquery", "LateralSubquery", "Exists", "ListQuery", "FunctionTableSubqueryArgumentExpression"):
            found.append(e.plan())
        todo += [e.children().apply(i) for i in range(e.children().size())]
    return found


def run_sql(spark: SparkSession, t: Tables, sql: str) -> DataFrame:
    """A guarded ad-hoc query over temporary views of the tables, those that it names: one query, which reads nothing else."""
    one = select_only(sql)
    asked = _insist_on_query(spark, one, {n.lower() for n in t})
    for name in t:
        if name.lower() in asked:
            t[name].createOrReplaceTempView(name)
    return spark.sql(one)


def refused(spark: SparkSession, t: Tables, sql: str) -> bool:
    try:
        run_sql(spark, t, sql)
    except (NotReadOnly, ParseException):
        return True
    return False
