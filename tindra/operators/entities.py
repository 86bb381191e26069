"""Entity resolution: redirects, containment and alias joins, strong-key upserts, candidates for review. Nothing is merged
without a decision; candidates are rows for people to judge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.python import jaro_winkler_similarity
from ..sources.scratch import keep
from . import ledger as L
from .components import connected
from .pairs import MOST, sampled, within

# The shortest text that containment may match, and the window of years around a production.
LEAST, BEFORE, AFTER = 5, 9, 1
PATRONYMICS = ("son", "dóttir", "dottir", "sen", "bur")
GRAM = 5


def redirects(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(src, dst) closed under following; a cycle stops before it comes round."""
    return spark.sql(
        """
        WITH RECURSIVE walk(src, dst, seen) AS (
          SELECT src, dst, array(src, dst) FROM {r}
          UNION ALL
          SELECT w.src, r.dst, concat(w.seen, array(r.dst)) FROM walk w JOIN {r} r ON w.dst = r.src
          WHERE NOT array_contains(w.seen, r.dst))
        SELECT src, max_by(dst, size(seen)) AS dst FROM walk GROUP BY src""",
        r=edges.select("src", "dst"),
    )


def apply_redirects(df: DataFrame, column: str, closed: DataFrame) -> DataFrame:
    r = closed.select(F.col("src").alias(column), F.col("dst").alias("_to"))
    return df.join(r, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def grams(x, n: int = GRAM):
    """Distinct character n-grams; a shorter text has none."""
    return F.when(F.length(x) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - n + 1), lambda i: F.substring(X.c(x), i, n))))


def rarest(df: DataFrame, text: str, seen: DataFrame, size: int = GRAM) -> DataFrame:
    """df with g, the n-gram of its text that seen(g, df) counts least, ties to the smaller one; a text with an n-gram that isn't
    seen is left out. Distinct texts only choose, so copies cost nothing."""
    g = df.select(F.col(text).alias("_t")).distinct().select("_t", F.explode(grams("_t", size)).alias("g"))
    best = g.join(seen, "g", "left").groupBy("_t").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "g")).alias("b"))
    return df.join(best.filter("b.df > 0").select(F.col("_t"), F.col("b.g").alias("g")), F.col(text) == F.col("_t")).drop("_t")


def contained(left: DataFrame, right: DataFrame, least: int = LEAST) -> DataFrame:
    """(ln, rn, exact) for the distinct texts of left(ln) and right(rn): equal, or one within the other when the shorter has
    `least` characters or more.

    No nested loop: a text that holds another holds all of its n-grams, so the shorter side sends the one that fewest of the
    longer texts have, the longer side all of its own, and the pairs that meet are checked. An n-gram that no longer text has
    settles the matter. n is GRAM, or `least` where that is less. Equal norms come from an equi-join of their own.
    """
    size = min(least, GRAM)
    left, right = left.select("ln").distinct(), right.select("rn").distinct()
    equal = left.join(right, F.col("ln") == F.col("rn")).select("ln", "rn", F.lit(True).alias("exact"))

    def within(short, sn, long, ln):
        t = long.withColumn("g", F.explode(grams(ln, size)))
        s = rarest(short.filter(F.length(sn) >= least), sn, t.groupBy("g").agg(F.count(F.lit(1)).alias("df")), size)
        return s.join(t, "g").filter(F.col(ln).contains(F.col(sn)) & (F.col(ln) != F.col(sn))).select("ln", "rn")

    a, b = within(left, "ln", right, "rn"), within(right, "rn", left, "ln")
    return equal.unionByName(a.unionByName(b).distinct().select("ln", "rn", F.lit(False).alias("exact")))


def containment(left: DataFrame, right: DataFrame, least: int = LEAST) -> DataFrame:
    """(l, r, exact) for left(l, ln) and right(r, rn) norms, as contained() of their texts. Those who want one row a left side
    join texts and aggregate first: many rows of a text make many pairs."""
    return contained(left, right, least).join(left.select("l", "ln"), "ln").join(right.select("r", "rn"), "rn").select("l", "r", "exact").distinct()


def funding_matches(productions: DataFrame, awards: DataFrame) -> DataFrame:
    """productions(l, ln, year) with their awards(r, rn, ryear, amount): count, total, years, confidence and status. Awards of
    one norm and year are summed before they meet, and productions of one norm and year meet them once."""
    money = awards.groupBy("rn", "ryear").agg(L.awards(awards).alias("n"), L.total(awards).alias("amount"))
    asked = productions.select("ln", "year").distinct()
    pairs = asked.join(contained(asked, money), "ln").join(money, "rn")
    near = pairs.filter(F.col("year").isNull() | F.col("ryear").isNull() | F.col("ryear").between(F.col("year") - BEFORE, F.col("year") + AFTER))
    n = near.groupBy(F.col("ln").alias("_ln"), F.col("year").alias("_year")).agg(F.sum("n").alias("matches"), F.sum("amount").cast("double").alias("total"), F.array_join(F.transform(F.sort_array(F.collect_set("ryear")), lambda y: y.cast("string")), ",").alias("years"), F.max("exact").alias("exact"))
    out = productions.select("l", "ln", "year").join(n, (F.col("ln") == F.col("_ln")) & F.col("year").eqNullSafe(F.col("_year")), "left")
    return out.select("l", F.coalesce("matches", F.lit(0)).alias("matches"), "total", F.coalesce("years", F.lit("")).alias("years"), match_confidence("exact").alias("confidence"), xref_status("matches", "year").alias("status"))


def match_confidence(exact):
    return F.when(X.c(exact), "high").when(X.c(exact).isNull(), "none").otherwise("medium")


def xref_status(matches, year, first: int = 2021):
    return F.when(F.coalesce(X.c(matches), F.lit(0)) > 0, "matched").when(X.c(year) >= first, "no_record_in_window").otherwise("before_window")


def longest_alias(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """texts(id, text) with the key of the longest alias (key, alias, ord) they hold; ties to the earlier alias.

    Aliases are words or phrases: a text that holds one holds its first word, so both meet on words.
    """
    a = aliases.withColumn("w", F.get(F.split("alias", " "), F.lit(0)))
    words = texts.select("id", "text", F.explode(F.array_distinct(F.split("text", " "))).alias("w"))
    hits = words.join(a, "w").filter(F.concat(F.lit(" "), "text", F.lit(" ")).contains(F.concat(F.lit(" "), "alias", F.lit(" "))))
    best = hits.groupBy("id").agg(F.max_by("key", F.struct(F.length("alias"), -F.col("ord"))).alias("key"))
    return texts.select("id").join(best, "id", "left")


def strong_key_upsert(records: DataFrame) -> DataFrame:
    """records(key, norm, ord) -> (ord, entity): the same strong key is one entity; else the same norm is; else it is new.

    Phases instead of a sequence: a key's entity is that of its first record; that record belongs to the first record of its
    norm. A norm that comes under two keys is one entity, and a key under two norms as well. Records with a key are looked up by
    it and the others by their norm, so none meet on a null key.
    """
    named = records.filter("norm is not null")
    by_norm = named.groupBy("norm").agg(F.min("ord").alias("norm_first"))
    by_key = named.filter("key is not null").join(by_norm, "norm").groupBy("key").agg(F.min_by("norm_first", "ord").alias("norm_first"))
    keyed = named.filter("key is not null").select("ord", "key").join(by_key, "key")
    others = named.filter("key is null").select("ord", "norm").join(by_norm, "norm")
    return keyed.select("ord", F.col("norm_first").alias("entity")).unionByName(others.select("ord", F.col("norm_first").alias("entity")))


def strong_key_components(records: DataFrame) -> DataFrame:
    """records(key, norm, ord) -> (ord, entity, key): records that a chain of equal keys and equal norms connects are one entity, its
    number their smallest ord, and its key that of its first record with one.

    Where strong_key_upsert lets a name that was only seen beside a known key make an entity of its own, here every such name
    leads to that key's entity. Keys and norms are the nodes of a graph whose edges are the records that have both; a hot key
    or norm is one node with many edges, which the components' rounds aggregate partially.
    """
    k, n = F.concat(F.lit("k:"), F.col("key").cast("string")), F.concat(F.lit("n:"), "norm")
    node = keep(records.sparkSession, records.select("ord", F.col("key").cast("string").alias("key"), n.alias("n"), F.coalesce(n, k, F.concat(F.lit("o:"), F.col("ord").cast("string"))).alias("node"), k.alias("k")), "records")
    parts = connected(node.select("n", "k").distinct())
    at = node.join(parts.select(F.col("id").alias("node"), "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = at.groupBy("component").agg(F.min("ord").alias("entity"), F.min_by("key", F.when(F.col("key").isNotNull(), F.col("ord"))).alias("first_key"))
    return at.join(first, "component").select("ord", "entity", F.col("first_key").alias("key"))


def pick_unused(candidates: DataFrame) -> DataFrame:
    """candidates(id, other, score): each takes its best, and a target goes to its best taker; the rest wait for review."""
    mine = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    theirs = Window.partitionBy("other").orderBy(F.desc("score"), "id")
    best = candidates.withColumn("a", F.row_number().over(mine)).filter("a = 1")
    return best.withColumn("b", F.row_number().over(theirs)).select("id", "other", F.when(F.col("b") == 1, "linked").otherwise("review").alias("status"))


def by_name(entities: DataFrame, works: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, works, members): one entity a distinct name, its id the smallest of its rows and its works all of theirs;
    members(id, entity) holds every row, so copies of a name need no pairs. Rows without a name are no entities."""
    named = entities.filter("name_fold != ''")
    first = named.groupBy("name_fold").agg(F.min("id").alias("entity"))
    members = named.join(first, "name_fold").select("id", "entity")
    return first.select(F.col("entity").alias("id"), "name_fold"), works.join(members, "id").select(F.col("entity").alias("id"), "work").distinct(), members


def by_prefix(entities: DataFrame, most: int = MOST, n: int = 4) -> DataFrame:
    """Pairs (a < b) with the same first n folded characters."""
    return within(entities.select("id", F.substring("name_fold", 1, n).alias("p")), "p", "id", most).select("a", "b")


def by_works(works: DataFrame, least: int = 2, most: int = MOST) -> DataFrame:
    """Pairs (a < b) with `least` common works or more."""
    return within(works, "work", "id", most).groupBy("a", "b").count().filter(F.col("count") >= least).select("a", "b")


def block(entities: DataFrame, works: DataFrame, most_works: int = 2, most: int = MOST) -> DataFrame:
    """Candidate pairs (a < b): the same first four folded characters, or two common works or more. Large groups of either are
    cut into blocks of `most`."""
    return by_prefix(entities, most).unionByName(by_works(works, most_works, most)).distinct()


def without_decided(pairs: DataFrame, decided: DataFrame) -> DataFrame:
    """Pairs that nobody has merged or rejected yet, whichever way round they were noted."""
    d = decided.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return pairs.join(d, ["a", "b"], "left_anti")


LETTERS = 32


def letters(name) -> Column:
    """How many characters of a name fall into each of LETTERS classes of code points."""
    code = F.transform(F.filter(F.split(X.c(name), ""), lambda ch: ch != ""), lambda ch: F.ascii(ch) % LETTERS)
    return F.transform(F.sequence(F.lit(0), F.lit(LETTERS - 1)), lambda i: F.size(F.filter(code, lambda k: k == i)))


def jaro_winkler_bound(a, b, la, lb) -> Column:
    """At least the Jaro-Winkler similarity of names a and b with letters la and lb, by JVM expressions only: no more characters can
    match than both have of a class, and no matches can be in better order than in order."""
    a, b = X.c(a), X.c(b)
    m = F.aggregate(F.zip_with(X.c(la), X.c(lb), lambda x, y: F.least(x, y)), F.lit(0), lambda s, v: s + v)
    j = F.when(m > 0, (m / F.length(a) + m / F.length(b) + 1) / 3).otherwise(0.0)
    same = F.lit(0)
    for k in range(4, 0, -1):
        hit = (F.length(a) >= k) & (F.length(b) >= k) & (F.substring(a, 1, k) == F.substring(b, 1, k))
        same = F.when(hit, k).otherwise(same) if k == 4 else F.when((same == 0) & hit, k).otherwise(same)
    return F.when(a == b, 1.0).otherwise(F.when(j > 0.7, j + 0.1 * same * (1 - j)).otherwise(j)) + 1e-9


def compare(pairs: DataFrame, entities: DataFrame, works: DataFrame | None, exact: bool = True) -> DataFrame:
    """Agreement levels of each pair: names (2: 0.92 or more, 1: 0.85 or more) and works (2: two or more, 1: one). Without
    exact, pairs whose bound is below 0.85 have a null jw and the level 0, and don't go to Python. Without works, the pairs have
    counted them (shared); other columns of the pairs stay."""
    more = [c for c in pairs.columns if c not in ("a", "b", "shared")]
    named = entities.select("id", "name_fold") if exact else entities.select("id", "name_fold", letters("name_fold").alias("l"))
    left, right = (named.select(*[F.col(c).alias(f"{c[0]}{k}") for c in named.columns]).withColumnRenamed(f"i{k}", k) for k in "ab")
    rows = pairs.join(left, "a").join(right, "b")
    if works is not None:
        # works of the pairs' entities only, which a small list of pairs finds without a shuffle of all works
        of = works.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi").distinct()
        shared = pairs.join(of.withColumnRenamed("id", "a"), "a").join(of.withColumnRenamed("id", "b"), ["b", "work"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
        rows = rows.join(shared, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    if exact:
        rows = rows.withColumn("jw", jaro_winkler_similarity("na", "nb"))
    else:
        rows = rows.withColumn("likely", jaro_winkler_bound("na", "nb", "la", "lb") >= 0.85)
        sure = rows.filter(~F.coalesce("likely", F.lit(True))).withColumn("jw", F.lit(None).cast("double"))
        rows = rows.filter(F.coalesce("likely", F.lit(True))).withColumn("jw", jaro_winkler_similarity("na", "nb")).unionByName(sure)
    return rows.select("a", "b", "jw", "shared", F.when(F.col("jw") >= 0.92, 2).when(F.col("jw") >= 0.85, 1).otherwise(0).alias("name_level"), F.least(F.col("shared"), F.lit(2)).cast("int").alias("work_level"), *more)


# The prior of a match, the least score of a candidate, rounds of EM, and the first guesses of how often matches
# reach each level of agreement (none, some, full) in names and in works.
PRIOR, THRESHOLD, ROUNDS = 2e-4, 0.8, 25
FIRST = {"name_level": (0.05, 0.15, 0.8), "work_level": (0.3, 0.3, 0.4)}


def level_counts(levels: DataFrame, column: str) -> list[int]:
    n = {r[0]: r[1] for r in levels.groupBy(column).agg(F.count(F.lit(1))).collect()}  # three rows at most
    return [n.get(k, 0) for k in range(3)]


def chance(counts: list[int]) -> list[float]:
    """u: how often pairs at random reach each level."""
    return [(n + 1) / (sum(counts) + 3) for n in counts]


def trained(counts: list[int], u: list[float], first: tuple[float, ...], prior: float = PRIOR, rounds: int = ROUNDS) -> list[float]:
    """m of one comparison: how often matches reach each level, by EM over the level counts of a rule's pairs, u held."""
    m, lam, total = list(first), prior, sum(counts)
    for _ in range(rounds if total else 0):
        p = [lam * a / (lam * a + (1 - lam) * b) for a, b in zip(m, u, strict=True)]
        found = sum(n * q for n, q in zip(counts, p, strict=True))
        lam = min(max(found / total, 1e-9), 0.5)
        m = [(n * q + 1e-3) / (found + 3e-3) for n, q in zip(counts, p, strict=True)]
    return m


def weights(m: dict[str, list[float]], u: dict[str, list[float]], prior: float = PRIOR) -> dict[tuple[int, int], float]:
    """The probability of a match of each pair of levels (name, works)."""
    out = {}
    for a in range(3):
        for b in range(3):
            yes = prior * m["name_level"][a] * m["work_level"][b]
            out[a, b] = yes / (yes + (1 - prior) * u["name_level"][a] * u["work_level"][b])
    return out


def dedupe(entities: DataFrame, works: DataFrame, threshold: float = THRESHOLD, sample: int = 1_000_000, most: int = MOST) -> DataFrame:
    """(a, b, score, shared, cluster): candidate pairs at or over the threshold, and the smallest id of those they connect.

    u comes from random pairs of all entities. m of each comparison comes from the pairs of the blocking rule that doesn't look at
    it: the works' from pairs of one name prefix, the names' from pairs with common works. Scores are rounded to four places.
    """
    spark = entities.sparkSession
    at_random = compare(keep(spark, sampled(entities, "id", sample), "sample"), entities, works, exact=False)
    u = {c: chance(level_counts(at_random, c)) for c in FIRST}
    shared = keep(spark, common_works(works, most), "common")
    levels = keep(spark, compare(near(shared, entities), entities, None, exact=False), "levels")
    some = levels.filter("prefix").groupBy("work_level").agg(F.count(F.lit(1)).alias("n"))
    n = {r.work_level: r.n for r in some.collect()}  # two rows at most
    at_work = [prefix_pairs(entities, most) - sum(n.values()), n.get(1, 0), n.get(2, 0)]
    m = {
        "work_level": trained(at_work, u["work_level"], FIRST["work_level"]),
        "name_level": trained(level_counts(levels.filter("work_level = 2"), "name_level"), u["name_level"], FIRST["name_level"]),
    }
    p = weights(m, u)
    # pairs of one prefix without a common work are only made where such a pair can reach the threshold, and of these only the likely
    enough = [a for a in range(3) if round(p[a, 0], 4) >= threshold]
    if enough:
        alone = prefix_only(entities, shared, most, likely=0 not in enough)
        levels = levels.unionByName(compare(alone, entities, None, exact=False))
    score = F.coalesce(*[F.when((F.col("name_level") == a) & (F.col("work_level") == b), F.lit(round(x, 4))) for (a, b), x in p.items()])
    found = keep(spark, levels.withColumn("score", score).filter(F.col("score") >= threshold).select("a", "b", "score", "shared"), "found")
    return found.join(connected(found.select("a", "b")).select(F.col("id").alias("a"), F.col("component").alias("cluster")), "a")


def common_works(works: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b, shared), a < b: pairs with common works and how many. Works of one entity only are put aside before pairs are made."""
    many = works.groupBy("work").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("work")
    return within(keep(works.sparkSession, works.join(many, "work", "left_semi"), "many"), "work", "id", most).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def _prefixes(entities: DataFrame, n: int = 4) -> DataFrame:
    """(id, ps, c): the prefixes of an entity's rows, in order, and how many rows it has. Entities without a name have none."""
    return entities.filter("id is not null").groupBy("id").agg(F.sort_array(F.collect_set(F.substring("name_fold", 1, n))).alias("ps"), F.count(F.lit(1)).alias("c"))


def near(shared: DataFrame, entities: DataFrame) -> DataFrame:
    """(a, b, shared, prefix) of pairs with two common works or more, or with one and the same prefix of names. prefix: whether they
    have one in common."""
    e = _prefixes(entities).drop("c")
    at = shared.join(e.withColumnsRenamed({"id": "a", "ps": "pa"}), "a").join(e.withColumnsRenamed({"id": "b", "ps": "pb"}), "b")
    return at.select("a", "b", "shared", F.arrays_overlap("pa", "pb").alias("prefix")).filter((F.col("shared") >= 2) | F.col("prefix"))


def prefix_pairs(entities: DataFrame, most: int = MOST) -> int:
    """How many pairs of rows of different entities compare makes of the pairs of one prefix, mostly from the prefixes' counts: only
    entities of several prefixes, which may meet in more than one, are paired to take off the repetitions."""
    e = _prefixes(entities)
    at = e.select("id", "c", "ps", F.explode("ps").alias("p"))
    big = lambda x: F.sum(x.cast("decimal(38,0)"))
    c = F.col("c")
    every = at.groupBy("p").agg(big(c).alias("s"), big(c * c).alias("q")).agg(F.sum((F.col("s") * F.col("s") - F.col("q")).cast("decimal(38,0)"))).first()[0] or 0
    several = keep(entities.sparkSession, at.filter(F.size("ps") > 1), "several")
    met = within(several.select("p", F.struct("id", "c", "ps").alias("x")), "p", "x", most) if not several.isEmpty() else None
    again = 0
    if met is not None:
        first = F.element_at(F.array_intersect("a.ps", "b.ps"), 1)
        again = met.filter(F.col("p") != first).agg(big(F.col("a.c") * F.col("b.c"))).first()[0] or 0
    return int(every) // 2 - int(again)


def prefix_only(entities: DataFrame, shared: DataFrame, most: int = MOST, likely: bool = True) -> DataFrame:
    """(a, b, shared, prefix) of pairs of one prefix without common works. likely: only those with names that may be similar, tested where
    the pairs are made."""
    rows = entities.select(F.substring("name_fold", 1, 4).alias("p"), F.struct("id", "name_fold", letters("name_fold").alias("l")).alias("x"))
    met = within(rows, "p", "x", most).filter("a.id != b.id")
    if likely:
        met = met.filter(F.coalesce(jaro_winkler_bound("a.name_fold", "b.name_fold", "a.l", "b.l") >= 0.85, F.lit(True)))
    pairs = met.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()
    return pairs.join(shared, ["a", "b"], "left_anti").select("a", "b", F.lit(0).cast("long").alias("shared"), F.lit(True).alias("prefix"))


def survivor(pairs: DataFrame, ranks: DataFrame) -> DataFrame:
    """Which of a pair stays: the higher rank struct; a on a tie. ranks(id, rank)."""
    ra, rb = (ranks.select(F.col("id").alias(k), F.col("rank").alias(f"r{k}")) for k in "ab")
    keep = F.col("ra") >= F.col("rb")
    return pairs.join(ra, "a").join(rb, "b").select(F.when(keep, F.col("a")).otherwise(F.col("b")).alias("keep"), F.when(keep, F.col("b")).otherwise(F.col("a")).alias("drop"), *[c for c in pairs.columns if c not in ("a", "b")])


def merge_records(kind: str, pairs: DataFrame, entities: DataFrame, rank: list[str]) -> DataFrame:
    """(kind, keep, drop, keep_name, drop_name, score, shared) of pairs(a, b, score, shared), best first: the entity that ranks
    higher by the columns of rank stays."""
    kept = survivor(pairs, entities.select("id", F.struct(*rank).alias("rank")))
    names = [entities.select(F.col("id").alias(k), F.col("name").alias(f"{k}_name")) for k in ("keep", "drop")]
    return kept.join(names[0], "keep").join(names[1], "drop").select(F.lit(kind).alias("kind"), "keep", "drop", "keep_name", "drop_name", F.round("score", 3).alias("score"), "shared").orderBy(F.desc("score"), "keep", "drop")


def name_prefixes(entities: DataFrame, works: DataFrame) -> DataFrame:
    """(a, b, score, method): a name of two words or more that begins a longer one, where the rest is one patronymic or they
    share a work. All proper word prefixes of a name are looked up by equality."""
    e = entities.filter(F.size(F.split("name_fold", " ")) >= 2).groupBy("name_fold").agg(F.min("id").alias("id"))
    toks = F.split("name_fold", " ")
    longer = e.withColumn("k", F.explode(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(toks) - 1)))).filter(F.col("k") < F.size(toks))
    longer = longer.select(F.col("id").alias("b"), F.array_join(F.slice(toks, 1, F.col("k")), " ").alias("name_fold"), F.slice(toks, F.col("k") + 1, F.size(toks)).alias("extra"))
    pairs = longer.join(e.withColumnRenamed("id", "a"), "name_fold")
    w = works.distinct()
    shared = pairs.select("a", "b").join(w.withColumnRenamed("id", "a"), "a").join(w.withColumnRenamed("id", "b"), ["b", "work"], "left_semi").select("a", "b").distinct().withColumn("shared", F.lit(True))
    last = F.get("extra", F.lit(0))
    pat = (F.size("extra") == 1) & last.rlike(f"({'|'.join(PATRONYMICS)})$")
    rows = pairs.join(shared, ["a", "b"], "left").withColumn("pat", pat).filter(F.col("pat") | F.col("shared"))
    return rows.select("a", "b", F.when(F.col("pat"), 0.9).otherwise(0.84).alias("score"), F.when(F.col("pat"), "name_prefix+patronymic").otherwise("name_prefix+shared_work").alias("method"))


def decide(pairs: DataFrame, merges: DataFrame) -> DataFrame:
    """Review state of each pair: merged, rejected or open. merges(x, y, decision)."""
    d = merges.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "decision").dropDuplicates(["a", "b"])
    return pairs.join(d, ["a", "b"], "left").withColumn("decision", F.coalesce("decision", F.lit("open")))
