"""The entity spine: titles, people and companies from productions, a member registry and the award ledger.

Which source wins is explicit: every input carries an order (src, row), an entity is the first row of its norm in that order,
and its id is that row's place among all first rows. Uncertain matches become alias rows with status unresolved; nothing
uncertain is merged.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.scratch import keep
from . import entities as E
from . import ledger as L
from .numbering import numbered

# Fixed values.
KINDS = {"leikin_kvikmynd": "film", "leikid_sjonvarp": "series", "heimildamynd": "documentary", "stuttmynd": "short"}
ROLES = ("director", "writer", "producer")
NAMES = ("company", "applicant", *ROLES)
FITTING = {"film": "movie,tvMovie,video", "documentary": "movie,tvMovie,video", "short": "short,tvShort", "series": "tvSeries,tvMiniSeries"}
NEAR = {"film": 1, "documentary": 1, "short": 1, "series": 2}
# What tells rows of a merged ledger apart, by what they are merged for.
GRAINS = {
    "title": ("project_title", "family", "year", "format_track", "source_id"), "company": ("company", "family", "year", "unpaid"), "pair": ("project_title", "company"),
    **{role: ("project_title", role) for role in ROLES},
}


def with_ids(df: DataFrame, *order: str) -> DataFrame:
    """Ids from 1 in the given order, which must tell rows apart where many could be equal."""
    return numbered(df, *order)


def merged_ledger(ledger: DataFrame, *grains: str) -> DataFrame:
    """The ledger in one pass as rows of each grain: (grain, the columns of the grains, null where a grain has none, row, n_awards,
    amount, amount_isk): the smallest row, how many awards it stands for, and sums of what was paid or else promised, and of what was
    paid (unpaid, in the grain company, tells apart those without). Sums have the type of the amounts, so these are whole or decimal."""
    names = list(dict.fromkeys(c for g in grains for c in GRAINS[g]))
    rows = ledger.select("row", *[F.col("amount_isk").isNull().alias(c) if c == "unpaid" else c for c in names], "amount_isk", X.truthy("amount_isk", "commitment_isk").alias("amount"))
    without = {g: sum(1 << i for i, c in enumerate(reversed(names)) if c not in GRAINS[g]) for g in grains}  # a bit a column, the first highest
    grain = F.coalesce(*[F.when(F.grouping_id() == bits, g) for g, bits in without.items()])
    sums = [F.min("row").alias("row"), F.count(F.lit(1)).alias("n_awards"), F.sum("amount").alias("amount"), F.sum("amount_isk").alias("amount_isk")]
    return rows.groupingSets([list(GRAINS[g]) for g in grains], *names).agg(grain.alias("grain"), *sums)


def clean_ledger(ledger: DataFrame) -> DataFrame:
    """Names and companies without grant labels, cnorm, the company's norm; titles split from their former names. A spelling is
    cleaned once, however many rows have it: the distinct ones are written, and rows look theirs up. A merged ledger has a part of
    these columns."""
    of = [c for c in NAMES if c in ledger.columns]
    out, more = ledger, ["cnorm"] * ("company" in of)
    if "project_title" in ledger.columns:
        titles = ledger.select(F.coalesce("project_title", F.lit("")).alias("_title")).distinct().withColumn("t", X.clean_title("_title"))
        titles = keep(ledger.sparkSession, titles.select("_title", "t.title", "t.former").withColumn("norm", X.name_norm("title")), "titles")
        out, more = out.withColumn("_title", F.coalesce("project_title", F.lit(""))).join(titles, "_title", "left"), ["title", "former", "norm", *more]
    if of:
        spellings = ledger.select(F.explode(F.array(*of)).alias("name")).filter("name is not null").distinct()
        names = keep(ledger.sparkSession, spellings.withColumn("clean", X.clean_entity("name")).withColumn("cnorm", F.when(F.col("clean").isNotNull(), X.company_norm("clean"))), "names")
    for name in of:
        out = out.join(names.select(F.col("name").alias(name), F.col("clean").alias(f"_{name}"), *[F.col("cnorm")] * (name == "company")), name, "left")
    return out.select(*[F.col(f"_{c}").alias(c) if c in of else c for c in ledger.columns], *more)


def manual_merges(closed: DataFrame, entities: DataFrame) -> DataFrame:
    """(name, id, method, status): the dropped name of each closed redirect (src, dst, and name where it is known) whose end
    is an entity(id, norm); the norm stands for a name that isn't known."""
    name = F.coalesce("name", "src") if "name" in closed.columns else F.col("src")
    r = closed.select(name.alias("name"), F.col("dst").alias("norm"))
    return r.join(entities.select("id", "norm"), "norm").select("name", "id", F.lit("manual_merge").alias("method"), F.lit("resolved").alias("status")).distinct()


def renamed_titles(ledger: DataFrame, renames: DataFrame, titles: DataFrame) -> DataFrame:
    """(alias, title_id, method, status): ledger(norm, title, year) names that a curated rename (src, dst) leads to titles(id, norm)."""
    r = ledger.join(renames.select(F.col("src").alias("norm"), "dst"), "norm").select(F.col("title").alias("alias"), F.col("dst").alias("norm"))
    return r.join(titles.select(F.col("id").alias("title_id"), "norm"), "norm").select("alias", "title_id", F.lit("renamed_to").alias("method"), F.lit("resolved").alias("status")).distinct()


def link_titles(titles: DataFrame, links: DataFrame) -> DataFrame:
    """titles(norm, year, imdb) with tconst: their own, else that of the last link(norm, year, tconst, ord) of the same norm
    and year, else that of the first link of the norm."""
    known = links.filter("tconst != ''")
    near = known.groupBy(F.col("norm").alias("_n"), F.col("year").alias("_y")).agg(F.max_by("tconst", "ord").alias("_near"))
    far = known.groupBy("norm").agg(F.min_by("tconst", "ord").alias("_far"))
    out = titles.join(near, (F.col("norm") == F.col("_n")) & F.col("year").eqNullSafe(F.col("_y")), "left").join(far, "norm", "left")
    return out.withColumn("tconst", F.coalesce(F.nullif("imdb", F.lit("")), "_near", "_far")).drop("_n", "_y", "_near", "_far")


def accept_titles(ours: DataFrame, candidates: DataFrame, used: DataFrame) -> DataFrame:
    """(id, tconst, status, why) for ours(id, norm, year, kind) and what a search found for them, candidates(id, pos, tconst,
    norm, year, kind): the first of equal norm, fitting kind and near year that nobody has, used(tconst) included, is linked;
    those of equal norm before it are for review, with why they don't fit.

    Titles take turns, later years first, then by id. A candidate has one norm, so turns matter within a norm only, and a
    fold over a norm's candidates is the whole sequence.
    """
    c = candidates.filter("tconst like 'tt%'").join(used.select("tconst").distinct(), "tconst", "left_anti")
    c = c.select("id", "pos", "tconst", "norm", F.col("year").alias("cyear"), F.col("kind").alias("ckind"))
    kind = F.when(F.col("kind").isin(*FITTING), F.col("kind")).otherwise("film")
    kinds, years = (F.create_map(*[F.lit(v) for kv in m.items() for v in kv])[kind] for m in (FITTING, NEAR))
    kind_ok = F.coalesce(F.array_contains(F.split(kinds, ","), F.col("ckind")), F.lit(False))
    year_ok = F.coalesce((F.col("cyear") != 0) & (F.col("year") != 0) & (F.abs(F.col("cyear") - F.col("year")) <= years), F.lit(False))
    why = F.when(kind_ok, "year_mismatch").otherwise("kind_mismatch")
    x = F.struct((-F.coalesce("year", F.lit(0))).alias("turn"), F.col("id").cast("long").alias("id"), F.col("pos").cast("long").alias("pos"), "tconst", (kind_ok & year_ok).alias("ok"), why.alias("why"))
    norms = ours.filter("norm != ''").join(c, ["id", "norm"]).groupBy("norm").agg(F.sort_array(F.collect_list(x)).alias("xs"))
    fold = """aggregate(xs, cast(struct(array() AS taken, array() AS done, array() AS out) AS struct<taken:array<string>,done:array<bigint>,out:array<struct<id:bigint,tconst:string,status:string,why:string>>>),
        (a, x) -> CASE WHEN array_contains(a.taken, x.tconst) OR array_contains(a.done, x.id) THEN a
            WHEN x.ok THEN struct(concat(a.taken, array(x.tconst)) AS taken, concat(a.done, array(x.id)) AS done, concat(a.out, array(struct(x.id AS id, x.tconst AS tconst, 'linked' AS status, cast(null AS string) AS why))) AS out)
            ELSE struct(a.taken AS taken, a.done AS done, concat(a.out, array(struct(x.id AS id, x.tconst AS tconst, 'review' AS status, x.why AS why))) AS out) END,
        a -> a.out)"""
    return norms.select(F.inline(F.expr(fold)))


def career_starts(people: DataFrame, careers: DataFrame) -> DataFrame:
    """people(nconst) with the least first feature year over the roles of their career, and those roles as JSON."""
    year = F.array_min(F.transform(F.map_values("roles"), lambda r: F.nullif(r["first_feature_year"], F.lit(0))))
    c = careers.filter("size(roles) > 0").groupBy("nconst").agg(F.min(year).alias("career_first_feature_year"), F.max(F.to_json("roles")).alias("career_json"))
    return people.join(c, "nconst", "left")


def first_of(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in the given order. Callers have merged equal rows, so a frequent key has few."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("n = 1").drop("n")


def merged(rows: DataFrame) -> DataFrame:
    """Rows that differ in `row` only as one, with its smallest."""
    return rows.groupBy([c for c in rows.columns if c != "row"]).agg(F.min("row").alias("row"))


def amount(led: DataFrame) -> Column:
    """What was paid, else promised; the rows of a merged ledger have it."""
    return F.col("amount") if "amount" in led.columns else X.truthy("amount_isk", "commitment_isk").alias("amount")


def company_entities(registry: DataFrame, ledger: DataFrame, closed: DataFrame) -> dict[str, DataFrame]:
    """Companies: the registry first, then names of the ledger (with norms); and an alias row per ledger name, resolved by equal
    norm or left unresolved beside the registry firm it contains or is contained in."""
    reg = registry.select(F.lit(0).alias("src"), "row", F.col("name"), F.col("type"), F.lit(1).alias("member"), X.company_norm("name").alias("norm"))
    led = ledger.filter(F.col("company").isNotNull() & (F.trim("company") != "")).select("row", F.col("company").alias("name"), F.col("cnorm").alias("norm"))
    led = merged(led).select(F.lit(1).alias("src"), "row", "name", F.lit(None).cast("string").alias("type"), F.lit(0).alias("member"), "norm")
    both = E.apply_redirects(reg.unionByName(led), "norm", closed).filter("norm != ''")
    firms = with_ids(first_of(both, "norm", "src", "row"), "src", "row").select("id", "name", "norm", "type", "member")
    names = both.filter("src = 1").groupBy("name", "norm").agg(F.min("row").alias("row"))
    exact = names.join(firms.select("id", "norm"), "norm").select("name", F.col("id").alias("company_id"), F.lit("exact_norm").alias("method"), F.lit("resolved").alias("status"))
    regs = firms.filter("member = 1 and length(norm) >= 4").select("id", F.col("norm").alias("rn"))
    loose = E.contained(names.filter("length(norm) >= 4").select(F.col("norm").alias("ln")), regs, least=4).filter("not exact")
    nearest = loose.join(regs, "rn").groupBy(F.col("ln").alias("norm")).agg(F.min("id").alias("company_id"))
    fuzzy = names.join(nearest, "norm").groupBy("name").agg(F.min("company_id").alias("company_id")).select("name", "company_id", F.lit("fuzzy_contains").alias("method"), F.lit("unresolved").alias("status"))
    manual = manual_merges(closed, firms).withColumnRenamed("id", "company_id")
    return {"company": firms, "alias": exact.unionByName(fuzzy).unionByName(manual)}


def title_entities(productions: DataFrame, ledger: DataFrame, closed: DataFrame, links: DataFrame | None = None) -> dict[str, DataFrame]:
    """Titles: the catalog first (with its funding, and its tconst from imdb or links), then ledger projects that name no known title. Long descriptions of
    support in the family annad are no titles."""
    prods = E.apply_redirects(productions.withColumn("norm", X.name_norm("title")), "norm", closed)
    if "imdb" not in prods.columns:
        prods = prods.withColumn("imdb", F.lit(None).cast("string"))
    prods = link_titles(prods, links) if links is not None else prods.withColumn("tconst", F.nullif("imdb", F.lit("")))
    led = E.apply_redirects(ledger, "norm", closed)
    cat = prods.select(F.lit(0).alias("src"), "row", "title", "norm", "year", "kind", F.col("source"), "tconst")
    own = merged(led.filter((F.col("norm") != "") & ~((F.coalesce("family", F.lit("")) == "annad") & X.is_support("project_title"))).select("row", "title", "norm", "year", "format_track", "source_id"))
    own = own.select(F.lit(1).alias("src"), "row", "title", "norm", F.col("year"), X.relabel("format_track", KINDS).alias("kind"), F.col("source_id").alias("source"), F.lit(None).cast("string").alias("tconst"))
    named = with_ids(first_of(cat.unionByName(own).filter("norm != ''"), "norm", "src", "row"), "src", "row")
    paid = led.filter("length(norm) >= 3").select(F.col("row").alias("r"), F.col("norm").alias("rn"), F.col("year").alias("ryear"), amount(led), *L.weight(led))
    funded = E.funding_matches(named.filter("src = 0").select(F.col("id").alias("l"), F.col("norm").alias("ln"), "year"), paid)
    titles = named.join(funded.drop("year").withColumnRenamed("l", "id"), "id", "left")
    known = keep(ledger.sparkSession, named.select("id", "norm"), "known")
    awards = led.join(known, "norm").select(F.col("id").alias("title_id"), "row", "year", "family", amount(led))
    names = led.select("norm", F.col("title").alias("alias"), F.lit("self").alias("method")).unionByName(led.select("norm", F.explode("former").alias("alias"), F.lit("former_title").alias("method")))
    aliases = names.distinct().join(known, "norm").select("alias", F.col("id").alias("title_id"), "method").distinct()
    return {"title": titles, "award": awards, "alias": aliases, "known": known}


def credit_edges(productions: DataFrame, ledger: DataFrame, titles: DataFrame, closed: DataFrame) -> dict[str, DataFrame]:
    """People and (title, person, role) edges; an edge that several sources give belongs to the first."""
    known = titles.select(F.col("id").alias("title_id"), "norm")
    one = productions.select(F.lit(0).alias("src"), "row", X.name_norm("title").alias("norm"), F.lit("director").alias("role"), F.col("director").alias("names"))
    led = merged(ledger.select("row", "norm", *ROLES).unpivot(["row", "norm"], list(ROLES), "role", "names").filter("names is not null")).withColumn("src", F.lit(1))
    rows = one.unionByName(led).filter("names is not null").select("src", "row", "norm", "role", F.posexplode(X.people("names")).alias("pos", "name"))
    rows = E.apply_redirects(rows.withColumn("pnorm", X.name_norm("name")), "pnorm", closed).filter("pnorm != ''").join(known, "norm")
    rows = keep(ledger.sparkSession, rows, "credits")
    people = with_ids(first_of(rows.select("src", "row", "role", "pos", "name", "pnorm"), "pnorm", "src", "row", "role", "pos"), "src", "row", "role", "pos").select("id", "name", F.col("pnorm").alias("norm"))
    edges = rows.join(people.select(F.col("id").alias("person_id"), F.col("norm").alias("pnorm")), "pnorm")
    edges = edges.withColumn("n", F.row_number().over(Window.partitionBy("title_id", "person_id", "role").orderBy("src", "row", "pos"))).filter("n = 1")
    roll = edges.groupBy("person_id").agg(F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"), F.count(F.lit(1)).alias("credit_count"))
    people = people.join(roll.withColumnRenamed("person_id", "id"), "id", "left")
    manual = manual_merges(closed, people).withColumnRenamed("id", "person_id")
    return {"person": people, "title_credit": edges.select("title_id", "person_id", "role", "src"), "person_alias": manual}


def company_edges(ledger: DataFrame, titles: DataFrame, firms: DataFrame, closed: DataFrame) -> DataFrame:
    rows = E.apply_redirects(ledger.filter("company is not null").select("norm", "cnorm").distinct(), "cnorm", closed)
    return rows.join(titles.select(F.col("id").alias("title_id"), "norm"), "norm").join(firms.select(F.col("id").alias("company_id"), F.col("norm").alias("cnorm")), "cnorm").select("title_id", "company_id").distinct()


class Spine(Mapping):
    """The spine tables of a cleaned ledger, each planned when it is first asked for, with what it needs of the others and no more.
    The ledger is read several times, so callers write it first. It has all rows, or those of the grains that the tables asked for
    need; award wants all rows, since awards are rows."""

    PARTS = {"company": "_firms", "company_alias": "_firms", "title": "_titles", "award": "_titles", "title_alias": "_titles", "person": "_people", "title_credit": "_people", "person_alias": "_people", "title_company": "_edges"}
    READS = {"_firms": ("company",), "_titles": ("title",), "_people": ("title", *ROLES), "_edges": ("title", "company", "pair")}

    def __init__(self, productions: DataFrame, registry: DataFrame, led: DataFrame, closed: dict[str, DataFrame], links: DataFrame | None = None):
        self._all, self._registry, self._led, self._closed, self._links = productions, registry, led, closed, links

    def __getitem__(self, name: str) -> DataFrame:
        if name == "award" and "grain" in self._led.columns:
            raise ValueError("awards are rows: they want the ledger itself, not a merged one")
        return getattr(self, self.PARTS[name])[name]

    def __iter__(self):
        return iter(self.PARTS)

    def __len__(self) -> int:
        return len(self.PARTS)

    def _of(self, *grains: str) -> DataFrame:
        return self._led.filter(F.col("grain").isin(*grains)) if "grain" in self._led.columns else self._led

    @cached_property
    def _productions(self) -> DataFrame:
        return keep(self._all.sparkSession, merged(self._all), "productions")

    @cached_property
    def _firms(self) -> dict[str, DataFrame]:
        led = self._of("company")
        firms = company_entities(self._registry, led, self._closed["company"])
        yearly = led.filter("company is not null").groupBy(F.col("cnorm").alias("norm"), "year").agg(L.awards(led), F.sum(amount(led)).alias("total"))
        money = yearly.groupBy("norm").agg(F.sum("awards").alias("awards"), F.sum("total").alias("total"), F.sort_array(F.collect_set("year")).alias("years"))
        company = firms["company"].join(money, "norm", "left").withColumn("awards", F.coalesce("awards", F.lit(0))).withColumn("total", F.coalesce("total", F.lit(0)))
        return {"company": company, "company_alias": firms["alias"], "known": firms["company"]}

    @cached_property
    def _titles(self) -> dict[str, DataFrame]:
        titles = title_entities(self._productions, self._of("title"), self._closed["title"], self._links)
        return {"title": titles["title"], "award": titles["award"], "title_alias": titles["alias"], "known": titles["known"]}

    @cached_property
    def _people(self) -> dict[str, DataFrame]:
        return credit_edges(self._productions, self._of(*ROLES), self._titles["known"], self._closed["person"])

    @cached_property
    def _edges(self) -> dict[str, DataFrame]:
        return {"title_company": company_edges(self._of("pair"), self._titles["known"], self._firms["known"], self._closed["company"])}


def build(productions: DataFrame, registry: DataFrame, ledger: DataFrame, closed: dict[str, DataFrame], links: DataFrame | None = None) -> Spine:
    """The spine tables. Inputs carry `row`, their arrival order; closed has redirects for company, person and title; links
    are imdb links."""
    return Spine(productions, registry, keep(ledger.sparkSession, clean_ledger(ledger), "ledger"), closed, links)


def strong_people(credits: DataFrame, people: DataFrame) -> DataFrame:
    """Fold credits(key, name, ord) into people(id, norm): by key, else by name, else new. Returns (ord, entity, is_new).

    One name under two keys is one person, and the first key stays with it: that is what name precedence means.
    """
    base = people.select((-F.col("id")).alias("ord"), F.lit(None).cast("string").alias("key"), "norm")
    new = credits.select("ord", "key", X.name_norm("name").alias("norm"))
    out = E.strong_key_upsert(base.unionByName(new)).filter("ord > 0")
    return out.select("ord", F.when(F.col("entity") < 0, -F.col("entity")).otherwise(F.col("entity")).alias("entity"), (F.col("entity") > 0).alias("is_new"))


def verify_titles(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """ours(key, title) against theirs(key, primary, original): ok, a mismatch without a common word, or not there."""
    rows = ours.join(theirs, "key", "left")
    common = F.arrays_overlap(X.tokens("title"), F.array_union(X.tokens("primary"), X.tokens("original")))
    return rows.select("key", F.when(F.col("primary").isNull(), "not_in_imdb").when(common, "ok").otherwise("TITLE_MISMATCH").alias("status"))
