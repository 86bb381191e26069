"""Graph queries: titles are orders, people are suppliers, roles are line flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from .ledger import read
from .registry import query

CREDITS = "WITH c AS (SELECT l_orderkey AS title, l_suppkey AS person, l_returnflag || l_linestatus AS role, l_returnflag AS layer FROM lineitem)"
EDGES = f"{CREDITS}, d AS (SELECT DISTINCT title, person FROM c), e AS (SELECT x.person AS a, y.person AS b, count(*)::BIGINT AS shared FROM d x JOIN d y ON x.title = y.title AND x.person < y.person GROUP BY 1, 2 HAVING count(*) >= 2)"
LAYER = "l AS (SELECT person, layer FROM (SELECT person, layer, row_number() OVER (PARTITION BY person ORDER BY count(*) DESC, CASE layer WHEN 'N' THEN 0 WHEN 'R' THEN 1 ELSE 2 END) AS k FROM c GROUP BY 1, 2) WHERE k = 1)"
ORDER = ["N", "R", "A"]


def credits(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("title"), F.col("l_suppkey").alias("person"), F.concat("l_returnflag", "l_linestatus").alias("role"), F.col("l_returnflag").alias("layer"))


@query("SELECT l_suppkey AS person, o_orderkey AS title, year(o_orderdate)::INT AS year, count(*)::BIGINT AS roles FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3")
def filmography(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("title"), F.year("o_orderdate").alias("year"))
    return credits(spark, sf_dir).join(o, "title").groupBy("person", "title", "year").agg(F.count(F.lit(1)).alias("roles"))


@query(f"{CREDITS} SELECT y.person, count(*)::BIGINT AS n FROM c x JOIN c y ON x.title = y.title AND y.person <> x.person WHERE x.person = 7 GROUP BY 1 ORDER BY n DESC, person LIMIT 8")
def collaborators_rolepairs(spark, sf_dir):
    return G.collaborators(credits(spark, sf_dir), 7, distinct=False)


@query(f"{CREDITS} SELECT y.person, count(DISTINCT y.title)::BIGINT AS n FROM c x JOIN c y ON x.title = y.title AND y.person <> x.person WHERE x.person = 7 GROUP BY 1 ORDER BY n DESC, person LIMIT 8")
def collaborators_distinct(spark, sf_dir):
    return G.collaborators(credits(spark, sf_dir), 7)


@query(f"{EDGES}, {LAYER}, t AS (SELECT x.person AS a, y.person AS b, array_to_string(list_slice(list_sort(list(x.title)), 1, 40), ',') AS titles FROM d x JOIN d y ON x.title = y.title AND x.person < y.person GROUP BY 1, 2) SELECT a, b, shared, titles, CASE WHEN la.layer = lb.layer THEN la.layer ELSE 'mixed' END AS edge_class FROM e JOIN t USING (a, b) JOIN l la ON la.person = a JOIN l lb ON lb.person = b")
def collab_edges(spark, sf_dir):
    c = credits(spark, sf_dir)
    e = G.with_class(G.shared_titles(c), G.person_layers(c, ORDER))
    return e.select("a", "b", "shared", F.array_join(F.transform("titles", lambda t: t.cast("string")), ",").alias("titles"), "edge_class")


@query(f"{CREDITS}, {LAYER} SELECT * FROM l")
def person_layer_argmax(spark, sf_dir):
    return G.person_layers(credits(spark, sf_dir), ORDER)


@query(f"{EDGES} SELECT CASE WHEN a = 5 THEN b ELSE a END AS other, shared FROM e WHERE a = 5 OR b = 5")
def ego_network(spark, sf_dir):
    return G.ego(G.shared_titles(credits(spark, sf_dir)), 5)


@query(f"{EDGES} SELECT person, count(*)::BIGINT AS degree FROM (SELECT a AS person FROM e UNION ALL SELECT b FROM e) GROUP BY 1")
def degree(spark, sf_dir):
    return G.degrees(G.shared_titles(credits(spark, sf_dir)))


@query(f"{CREDITS} SELECT person, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, count(*)::BIGINT AS credits FROM c GROUP BY 1")
def person_rollup(spark, sf_dir):
    return G.rollup(credits(spark, sf_dir))


@query(f"{CREDITS}, n AS (SELECT person, count(*) AS busy FROM c GROUP BY 1) SELECT title, person FROM (SELECT title, person, row_number() OVER (PARTITION BY title ORDER BY busy DESC, person) AS k FROM c JOIN n USING (person) WHERE role = 'NO') WHERE k = 1")
def director_backfill(spark, sf_dir):
    return G.backfill(credits(spark, sf_dir), "NO")


@query(f"{CREDITS}, f AS (SELECT DISTINCT l_suppkey AS person, l_partkey AS title FROM lineitem) SELECT DISTINCT person FROM f WHERE person NOT IN (SELECT person FROM c JOIN f USING (person, title))")
def flagged_people(spark, sf_dir):
    f = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("person"), F.col("l_partkey").alias("title")).distinct()
    return G.flagged(credits(spark, sf_dir), f)


@query(f"{CREDITS} SELECT DISTINCT person, role FROM c WHERE (person, role) NOT IN (SELECT person, role FROM c WHERE title % 2 = 0)")
def mislinked_roles(spark, sf_dir):
    c = credits(spark, sf_dir)
    counts = c.groupBy("person", "role").agg(F.count_if(F.col("title") % 2 == 0).alias("n"))
    return G.mislinked_roles(c.select("person", "role").distinct(), counts)


@query("WITH f AS (SELECT l_suppkey AS person, l_returnflag AS role, l_orderkey AS title, year(o_orderdate)::INT AS year, o_orderstatus = 'F' AS film FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT person, role, min(year) FILTER (WHERE film) AS first_year, count(*) FILTER (WHERE film)::BIGINT AS features, count(*)::BIGINT AS credits FROM f GROUP BY 1, 2")
def careers(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("title"), F.year("o_orderdate").alias("year"), F.when(F.col("o_orderstatus") == "F", "movie").otherwise("tv").alias("kind"))
    c = credits(spark, sf_dir).select("title", "person", F.col("layer").alias("role")).join(o, "title")
    return G.career(c).select("person", "role", F.col("first.year").alias("first_year"), "features", "credits")
