"""Ledger queries over the driver's tables: awards are orders, companies are customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import ledger as L
from ..sources import versioned
from ..sources.scratch import new_path
from ..streaming import states
from .registry import query


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("family"), F.col("o_orderstatus").alias("format"), F.col("c_name").alias("company"), F.col("c_nationkey").alias("nation"), F.col("o_totalprice").alias("amount"), F.col("o_orderkey").alias("project"))


AWARDS = "WITH a AS (SELECT year(o_orderdate)::INT AS year, o_orderpriority AS family, o_orderstatus AS format, c_name AS company, o_totalprice AS amount, o_orderkey AS project FROM orders JOIN customer ON o_custkey = c_custkey)"
SUM = "sum(amount::DECIMAL(18,2))::DOUBLE"


@query(f"{AWARDS} SELECT family, count(*)::BIGINT AS awards, {SUM} AS total FROM a WHERE amount IS NOT NULL GROUP BY 1")
def funding_by_family(spark, sf_dir):
    return L.by(awards(spark, sf_dir).filter(L.having()), "family")


@query(f"{AWARDS} SELECT count(*)::BIGINT AS awards, {SUM} AS total FROM a")
def funding_totals(spark, sf_dir):
    return L.totals(awards(spark, sf_dir))


@query(f"{AWARDS}, p AS (SELECT * FROM a WHERE amount IS NOT NULL AND family = '2-HIGH' AND company ILIKE '%customer#00000001%') SELECT 'family' AS kind, family AS label, count(*)::BIGINT AS awards, {SUM} AS total FROM p GROUP BY family UNION ALL SELECT 'year', year::VARCHAR, count(*)::BIGINT, {SUM} FROM p GROUP BY year UNION ALL SELECT 'all', '', count(*)::BIGINT, {SUM} FROM p")
def funding_stats_filtered(spark, sf_dir):
    s = L.funding_stats(awards(spark, sf_dir), family="2-HIGH", company="customer#00000001")
    cols = ["awards", "total"]
    f = s["by_family"].select(F.lit("family").alias("kind"), F.col("family").alias("label"), *cols)
    y = s["by_year"].select(F.lit("year").alias("kind"), F.col("year").cast("string").alias("label"), *cols)
    return f.unionByName(y).unionByName(s["totals"].select(F.lit("all").alias("kind"), F.lit("").alias("label"), *cols))


@query(f"{AWARDS} SELECT company, count(*)::BIGINT AS awards, {SUM} AS total FROM a GROUP BY 1 ORDER BY total DESC, company LIMIT 20")
def top_recipients(spark, sf_dir):
    return L.top(awards(spark, sf_dir), 20)


@query(f"{AWARDS} SELECT project, company, year, amount FROM a ORDER BY amount DESC, project LIMIT 15")
def largest_awards(spark, sf_dir):
    return L.largest(awards(spark, sf_dir), 15, "project").select("project", "company", "year", "amount")


@query(f"{AWARDS} SELECT family, count(*)::BIGINT AS n, round_even({SUM} / count(amount), 0) AS mean, round_even(median(amount), 0) AS median, max(amount) AS max FROM a GROUP BY 1")
def stats_by_family(spark, sf_dir):
    return L.spread(awards(spark, sf_dir))


@query(f"{AWARDS}, n AS (SELECT *, trim(regexp_replace(regexp_replace(lower(coalesce(company, '')), '\\b(ehf|slf|sf|hf|ses)\\b', ' ', 'g'), '[^0-9a-záéíóúýþæöð]+', ' ', 'g')) AS norm FROM a) SELECT norm, count(*)::BIGINT AS awards, {SUM} AS total, array_to_string(list_sort(list(DISTINCT year)), ',') AS years FROM n WHERE norm <> '' GROUP BY 1")
def company_rollup_norm(spark, sf_dir):
    return L.companies(awards(spark, sf_dir))


@query(f"{AWARDS}, b AS (SELECT company FROM a GROUP BY 1 ORDER BY {SUM} DESC, company LIMIT 8), t AS (SELECT a.*, CASE WHEN b.company IS NULL THEN 'other' ELSE a.company END AS target FROM a LEFT JOIN b USING (company)) SELECT family AS source, format AS target, {SUM} AS total FROM a GROUP BY 1, 2 UNION ALL SELECT format, target, {SUM} FROM t GROUP BY 1, 2")
def flow_edges(spark, sf_dir):
    return L.flows(awards(spark, sf_dir))


@query(f"{AWARDS} SELECT year, format, count(*)::BIGINT AS n FROM a GROUP BY 1, 2")
def trend_counts(spark, sf_dir):
    return L.trends(awards(spark, sf_dir))


@query(f"{AWARDS} SELECT trim(split_part(company, '#', 2)) AS label, {SUM} AS total FROM a GROUP BY 1 ORDER BY total DESC, label LIMIT 25")
def top_n_treemap(spark, sf_dir):
    df = awards(spark, sf_dir).withColumn("label", F.trim(F.split_part("company", F.lit("#"), F.lit(2))))
    return L.top(df, 25, "label").select("label", "total")


@query(f"{AWARDS} SELECT company, count(*)::BIGINT AS awards, count(DISTINCT project)::BIGINT AS projects, {SUM} AS total, min(year) AS first_year, max(year) AS last_year, round_even(count(DISTINCT project) / (max(year) - min(year) + 1), 2) AS per_year FROM a GROUP BY 1")
def dossier_approvals(spark, sf_dir):
    return L.approvals(awards(spark, sf_dir))


@query(f"{AWARDS} SELECT coalesce({SUM}, 0) AS total, coalesce(round_even(sum(amount::DECIMAL(18,2))::DOUBLE / count(amount), 2), 0) AS average, coalesce(median(amount), 0) AS median FROM a WHERE year < 1900")
def summary_of_nothing(spark, sf_dir):
    return L.summary(awards(spark, sf_dir).filter("year < 1900"))


@query(f"{AWARDS}, s AS (SELECT coalesce({SUM}, 0) AS total, coalesce(round_even({SUM} / count(amount), 2), 0) AS average, coalesce(median(amount), 0) AS median FROM a) SELECT 'total' AS kind, '' AS label, total AS value FROM s UNION ALL SELECT 'average', '', average FROM s UNION ALL SELECT 'median', '', median FROM s UNION ALL SELECT 'category', family, {SUM} FROM a WHERE family IS NOT NULL GROUP BY 2 UNION ALL SELECT 'company', company, value FROM (SELECT company, {SUM} AS value FROM a WHERE company IS NOT NULL GROUP BY 1 ORDER BY value DESC, company LIMIT 5)")
def summary_of_awards(spark, sf_dir):
    s = L.allocation_summary(awards(spark, sf_dir))
    one = s["totals"].unpivot([], ["total", "average", "median"], "kind", "value").select("kind", F.lit("").alias("label"), "value")
    families = s["by_category"].select(F.lit("category").alias("kind"), F.col("family").alias("label"), F.col("total").alias("value"))
    return one.unionByName(families).unionByName(s["top_companies"].select(F.lit("company").alias("kind"), F.col("company").alias("label"), F.col("total").alias("value")))


@query("SELECT o_custkey AS title, min(src)::INT AS src, arg_min(o_orderkey, o_orderkey) FILTER (WHERE src = m) AS first_order FROM (SELECT *, min(src) OVER (PARTITION BY o_custkey) AS m FROM (SELECT *, CASE WHEN year(o_orderdate) < 1998 THEN 1 ELSE 0 END AS src FROM orders)) GROUP BY 1")
def first_source_wins(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("title"), F.when(F.year("o_orderdate") < 1998, 1).otherwise(0).alias("src"), F.col("o_orderkey").alias("first_order"))
    return L.first_source(o, ["title"], ["src", "first_order"])


@query("SELECT 'old' AS ledger, count(*)::BIGINT AS n FROM orders WHERE year(o_orderdate) < 1998 UNION ALL SELECT 'new', count(*)::BIGINT FROM orders WHERE year(o_orderdate) >= 1998")
def union_ledgers(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate"))
    old, new = o.filter("y < 1998").withColumn("ledger", F.lit("old")), o.filter("y >= 1998").drop("o_orderpriority").withColumn("ledger", F.lit("new"))
    return old.unionByName(new, allowMissingColumns=True).groupBy("ledger").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_suppkey, s_name, n_name, r_name, CASE r_name WHEN 'AFRICA' THEN 'south' WHEN 'ASIA' THEN 'east' ELSE r_name END AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def doc_matrix(spark, sf_dir):
    s, n, r = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    df = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return df.select("s_suppkey", "s_name", "n_name", "r_name", X.relabel("r_name", {"AFRICA": "south", "ASIA": "east"}).alias("label"))


@query("SELECT DISTINCT o_orderpriority AS family, o_orderstatus AS format FROM orders")
def distinct_families(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("family"), F.col("o_orderstatus").alias("format")).distinct()


@query("SELECT o_orderkey, CASE WHEN coalesce(o_totalprice, 0) = 0 THEN c_acctbal ELSE o_totalprice END AS amount, coalesce(nullif(c_mktsegment, 'MACHINERY'), 'none') AS segment, replace(format('{:,}', o_orderkey), ',', '.') || ' ISK' AS shown FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey > 0 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND c_name LIKE 'Customer#%' AND year(o_orderdate) BETWEEN 1996 AND 1998")
def predicate_mix(spark, sf_dir):
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    df = o.filter((F.col("o_orderkey") > 0) & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & F.year("o_orderdate").between(1996, 1998)).join(c.filter(F.col("c_name").startswith("Customer#")), o.o_custkey == c.c_custkey)
    return df.select("o_orderkey", X.truthy("o_totalprice", "c_acctbal").alias("amount"), F.coalesce(F.nullif("c_mktsegment", F.lit("MACHINERY")), F.lit("none")).alias("segment"), X.isk("o_orderkey").alias("shown"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def customers_with_large_award(spark, sf_dir):
    o = read(spark, sf_dir, "orders").filter("o_totalprice > 400000")
    return read(spark, sf_dir, "customer").join(o, F.col("c_custkey") == o.o_custkey, "left_semi").select("c_custkey")


@query("SELECT c_custkey, coalesce(count(o_orderkey), 0)::BIGINT AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def specs_left_join(spark, sf_dir):
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return read(spark, sf_dir, "customer").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT o_orderkey, o_orderpriority, (CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '3-MEDIUM' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END)::INT AS place FROM orders ORDER BY place, o_totalprice DESC, o_orderkey LIMIT 50")
def custom_order(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("place", L.rank_order("o_orderpriority", ["1-URGENT", "3-MEDIUM", "2-HIGH"]))
    return o.orderBy("place", F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_orderpriority", "place")


@query("WITH r AS (SELECT o_custkey AS project, o_orderpriority AS item, (CASE o_orderpriority WHEN '1-URGENT' THEN 0.7 WHEN '2-HIGH' THEN 0.2 ELSE 0.1 END)::DOUBLE AS weight, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS ok FROM orders GROUP BY 1, 2) SELECT project, coalesce(round_even(100 * sum(CASE WHEN ok = 1 THEN weight ELSE 0 END) / sum(weight), 1), 0) AS score, coalesce(string_agg(CASE WHEN ok = 0 THEN item END, ',' ORDER BY item), '') AS missing FROM r GROUP BY 1")
def readiness_score(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderpriority").alias("item"), "o_orderstatus")
    need = o.select("project", "item").distinct().withColumn("weight", F.when(F.col("item") == "1-URGENT", 0.7).when(F.col("item") == "2-HIGH", 0.2).otherwise(0.1))
    done = o.filter("o_orderstatus = 'F'").select("project", "item", F.lit("Done").alias("status")).distinct()
    return L.readiness(need, done)


@query("SELECT o_orderpriority AS family, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS f, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS o, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)::BIGINT AS p FROM orders GROUP BY 1")
def people_by_titles_pivot(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("s", F.lower("o_orderstatus")).groupBy(F.col("o_orderpriority").alias("family")).pivot("s", ["f", "o", "p"]).count()
    return o.select("family", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("f", "o", "p")])


@query("WITH u AS (SELECT l_partkey AS id, max(l_shipdate)::DATE AS last, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS sold FROM lineitem WHERE l_partkey % 5 = 0 GROUP BY 1) SELECT coalesce(p.id, u.id) AS id, CASE WHEN p.id % 10 = 0 THEN 'first' ELSE strftime(u.last, '%Y-%m-%d') END AS claim, coalesce(p.sold, 0) + coalesce(u.sold, 0) AS sold FROM (SELECT p_partkey AS id, 0.0::DOUBLE AS sold FROM part) p LEFT JOIN u USING (id)")
def versioned_merge(spark, sf_dir):
    """Claims and sums of lines merged into a table of parts: what is there stays, what is missing is filled, sums grow."""
    folder = new_path(spark, "parts")
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 10 == 0, "first").alias("claim"), F.lit(0.0).alias("sold"))
    versioned.create(p, folder, "id")
    lines = read(spark, sf_dir, "lineitem").filter("l_partkey % 5 = 0").groupBy(F.col("l_partkey").alias("id")).agg(F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("claim"), L.money_sum("l_quantity").alias("sold"))
    versioned.merge(spark, folder, lines, {"claim": versioned.keep_first, "sold": versioned.add}, insert=False)
    return versioned.read(spark, folder)


@query("SELECT least(user_id, user_id * 7 % 50) AS a, greatest(user_id, user_id * 7 % 50) AS b, arg_max(event_type, event_id) AS decision, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def decision_stream(spark, sf_dir):
    """Events as review decisions of pairs, in several micro-batches of a stream with state."""
    folder, name = new_path(spark, "decisions"), "spark.sql.streaming.stateStore.providerClass"
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("x"), (F.col("user_id") * 7 % 50).alias("y"), F.col("event_type").alias("decision"))
    rows.repartitionByRange(6, "seq").write.parquet(f"{folder}/in")
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(states.DECISIONS).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
        states.drain(states.decision_stream(stream), f"{folder}/out", f"{folder}/checkpoint", "update")
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    return states.last_of(spark, f"{folder}/out")
