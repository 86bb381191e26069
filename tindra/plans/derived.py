"""Readers, writers, parsers and entity operators on files, pages and records that Spark makes from the given tables. The SQL
computes what must come out from the tables themselves, without the way through text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import corpus, entities, graph, spine
from ..operators import parsers as P
from ..sources import sinks, tables
from ..sources.scratch import new_path
from .ledger import read
from .registry import query


def joined(df, group: str, order: str, row, head: str = "", tail: str = "", column: str = "html"):
    """(doc, column): the rows of a group as one text, in order, between head and tail. Groups are runs of keys of a fixed length."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("x")))), lambda z: z["x"]), "")
    return df.groupBy(F.expr(group).alias("doc")).agg(F.concat(F.lit(head), body, F.lit(tail)).alias(column))


def cells(*values) -> F.Column:
    return F.concat(F.lit("<tr>"), *[x for v in values for x in (F.lit("<td>"), F.col(v) if isinstance(v, str) else v, F.lit("</td>"))], F.lit("</tr>"))


def header(*names: str) -> str:
    return "<table><tr>" + "".join(f"<th>{n}</th>" for n in names) + "</tr>"


def dotted(x: str):
    """A number of thousands with its group dot."""
    return F.concat(F.expr(f"CAST(CAST({x} AS BIGINT) AS STRING)"), F.lit(".000"))


GROUP = "p_partkey div 50"
DUCK = "p_partkey // 50"


# ---- parsers
@query(f"SELECT {DUCK} AS doc, 0 AS t, (row_number() OVER (PARTITION BY {DUCK} ORDER BY p_partkey))::INT AS r, p_name || '|' || p_brand AS row FROM part UNION ALL SELECT DISTINCT {DUCK}, 0, 0, 'Mynd|Aðsókn' FROM part")
def p3_html_tables(spark, sf_dir):
    html = joined(read(spark, sf_dir, "part"), GROUP, "p_partkey", cells(F.concat(F.lit("<b>"), "p_name", F.lit("</b>")), "p_brand"), header("Mynd", "Aðsókn"), "</table><table><tr><td> </td></tr></table>")
    return html.select("doc", F.posexplode(P.tables("html")).alias("t", "rows")).select("doc", "t", F.posexplode("rows").alias("r", "row")).select("doc", "t", "r", F.array_join("row", "|").alias("row"))


@query(f"SELECT {DUCK} AS doc, p_name AS film, CASE WHEN p_size * 15000 <= 500000 THEN p_size * 15000 END::BIGINT AS week_admissions, CASE WHEN p_size * 11000 <= 500000 THEN p_size * 11000 END::BIGINT AS total_admissions, (floor(p_retailprice)::BIGINT * 1000)::BIGINT AS gross_isk, p_size::VARCHAR AS weeks_in_release FROM part")
def p4_admissions(spark, sf_dir):
    row = cells("p_name", F.col("p_size").cast("string"), F.concat(dotted("p_size * 15"), F.lit(" (1.000)")), dotted("p_size * 11"), F.concat(dotted("floor(p_retailprice)"), F.lit(" kr.")))
    html = joined(read(spark, sf_dir, "part"), GROUP, "p_partkey", row, header("Mynd", "Vikur", "Aðsókn", "Heildaraðsókn", "Tekjur"), "</table>")
    return P.admissions_tables(html).select("doc", "film", "week_admissions", "total_admissions", "gross_isk", "weeks_in_release")


@query(f"SELECT {DUCK} AS doc, p_name AS title, p_brand AS channel, (p_size * 1000)::BIGINT AS viewers, (p_size + 0.5)::DOUBLE AS rating_pct, p_size::BIGINT AS episodes FROM part")
def p5_viewership(spark, sf_dir):
    row = cells("p_name", "p_brand", dotted("p_size"), F.concat(F.col("p_size").cast("string"), F.lit(",5 %")), F.col("p_size").cast("string"))
    html = joined(read(spark, sf_dir, "part"), GROUP, "p_partkey", row, header("Heiti", "Stöð", "Áhorfendur", "%", "Fjöldi þátta"), "</table>")
    return P.viewership_tables(html).select("doc", "title", "channel", "viewers", "rating_pct", "episodes")


@query(f"SELECT {DUCK} AS doc, 'framleidsla' AS family, 'leikin_kvikmynd' AS format_track, p_name AS project_title, p_type AS writer, 'Mynd ehf.' AS company, (p_size * 1000000)::BIGINT AS amount_isk, (p_size * 2000000)::BIGINT AS total_isk FROM part")
def p2_archive_ledger(spark, sf_dir):
    n = F.col("p_size").cast("string")
    row = cells("p_name", "p_type", F.lit("Anna"), F.lit("Mynd ehf."), F.concat(n, F.lit(".000.000/"), (2 * F.col("p_size")).cast("string"), F.lit(".000.000")))
    head = "<h2>Framleiðslustyrkir:</h2><h3>Leiknar kvikmyndir</h3>" + header("Verkefni", "Handritshöf.", "Leikstjóri", "Umsækjandi", "Styrkur")
    html = joined(read(spark, sf_dir, "part"), GROUP, "p_partkey", row, head, "</table>").withColumn("year", F.lit(2017))
    return P.archive_ledger(html).select("doc", "family", "format_track", "project_title", "writer", "company", "amount_isk", "total_isk")


HEAD = "Framleiðslustyrkir\n\nLeiknar kvikmyndir\nVerkefni            Handritshöfundur     Leikstjóri        Umsækjandi                  Styrkur      Samtals      Vilyrði\n"


@query(f"SELECT {DUCK} AS doc, 'framleidsla' AS family, 'leikin_kvikmynd' AS format_track, p_name AS project_title, 'Anna Jónsdóttir' AS writer, 'Mynd ehf.' AS company, CASE WHEN p_size % 2 = 0 THEN 'Sigga Ben' END AS producer, (p_size * 1000000)::BIGINT AS amount_isk, (p_size * 2000000)::BIGINT AS total_isk, CASE WHEN p_size % 3 = 0 THEN p_size * 3000000 END::BIGINT AS commitment_isk, NULL::VARCHAR AS confidence FROM part")
def p1_layout_ledger(spark, sf_dir):
    pad = lambda x, n: F.rpad(x, n, " ")
    n = lambda k: F.concat((k * F.col("p_size")).cast("string"), F.lit(".000.000"))
    row = F.concat(pad(F.col("p_name"), 20), pad(F.lit("Anna Jónsdóttir"), 21), pad(F.lit("Jón Páll"), 18), pad(F.when(F.col("p_size") % 2 == 0, "Mynd ehf. / Sigga Ben").otherwise("Mynd ehf."), 28), pad(n(1), 13), F.when(F.col("p_size") % 3 == 0, F.concat(pad(n(2), 13), n(3))).otherwise(n(2)), F.lit("\n"))
    text = joined(read(spark, sf_dir, "part"), GROUP, "p_partkey", row, HEAD, column="text").withColumns({"year": F.lit(2021), "source_id": F.lit("src")})
    return P.layout_ledger(text).select("doc", "family", "format_track", "project_title", "writer", "company", "producer", "amount_isk", "total_isk", "commitment_isk", "confidence")


@query(f"SELECT {DUCK} AS doc, p_name AS title, 1950 + p_size AS year, p_type AS director, 'tt' || lpad(p_partkey::VARCHAR, 7, '0') AS imdb FROM part")
def p6_film_lists(spark, sf_dir):
    row = F.concat(F.lit("{{Kvikmyndalisti\n| titill = [["), "p_name", F.lit("]]\n| frumsýnd = "), (1950 + F.col("p_size")).cast("string"), F.lit("\n| leikstjóri = ''"), "p_type", F.lit("''\n| imdb = https://www.imdb.com/title/tt"), F.lpad(F.col("p_partkey").cast("string"), 7, "0"), F.lit("/\n}}\n"))
    return P.film_lists(joined(read(spark, sf_dir, "part"), GROUP, "p_partkey", row, column="text"), "film").select("doc", "title", "year", "director", "imdb")


@query(f"SELECT {DUCK} AS doc, p_partkey AS kvik_id, p_name || ' &' AS title, 1950 + p_size AS year, 'Lokið' AS status FROM part")
def p7_series_list(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    row = F.concat(F.lit('<li><a class="x" href="https://a.example/mynd/?id='), key, F.lit('"><img alt="'), "p_name", F.lit(' &amp;"> '), (1950 + F.col("p_size")).cast("string"), F.lit(" Lokið</a></li>"))
    twice = joined(read(spark, sf_dir, "part"), GROUP, "p_partkey", F.concat(row, row))
    return P.series_list(twice, "series").select("doc", "kvik_id", "title", "year", "status")


@query("SELECT s_suppkey // 20 AS doc, s_name AS name, 'https://firma' || s_suppkey || '.example' AS website, 'a.b' || s_suppkey || '@firma.example' AS email, lpad((5550000 + s_suppkey)::VARCHAR, 7, '0') AS phone FROM supplier")
def p8_member_registry(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    row = F.concat(F.lit('<h2 class="memberfirmname">'), "s_name", F.lit('</h2><p class="memberfirmtext">Gata 1, '), (5550000 + F.col("s_suppkey")).cast("string"), F.lit(" a.b"), k, F.lit('@firma.example <a href="https://firma'), k, F.lit('.example">x</a></p>'))
    return P.member_registry(joined(read(spark, sf_dir, "supplier"), "s_suppkey div 20", "s_suppkey", row)).select("doc", "name", "website", "email", "phone")


@query(r"""WITH p AS (SELECT 'frettir_' || page_id AS name, html, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g'), '&quot;?', '"', 'g'), '&(#x27|#39|apos);', '''', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')), ''), 'frettir ' || page_id) AS title, CASE WHEN regexp_matches(html, '\b(\d{2})\.(\d{2})\.(\d{4})\b') THEN regexp_replace(regexp_extract(html, '\b\d{2}\.\d{2}\.\d{4}\b'), '(..)\.(..)\.(....)', '\3-\2-\1') ELSE '' END AS date FROM pages) SELECT name, 'frettir' AS section, title, date, coalesce(try_cast(left(date, 4) AS INT), try_cast(regexp_extract(name || ' ' || title, '\b(20\d\d)\b', 1) AS INT)) AS year, md5(html) AS md5 FROM p""")
def p9_site_pages(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select(F.concat(F.lit("frettir_"), F.col("page_id").cast("string")).alias("name"), F.col("html").alias("text"))
    return P.site_pages(p).select("name", "section", "title", "date", "year", F.md5("main_html").alias("md5"))


CREW = "SELECT l_orderkey AS title, l_returnflag AS role, (row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, 'nm' || l_suppkey) - 1)::INT AS pos, 'nm' || l_suppkey AS key FROM lineitem"


@query(CREW)
def p10_flat_files(spark, sf_dir):
    """Lines as the crews of title files, one map a file, and back."""
    li = read(spark, sf_dir, "lineitem")
    person = F.struct(F.concat(F.lit("nm"), F.col("l_suppkey").cast("string")).alias("nconst"), F.lit(None).cast("string").alias("name"))
    each = li.groupBy("l_orderkey", "l_returnflag").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", person.alias("p")))), lambda z: z["p"]).alias("people"))
    files = each.groupBy(F.col("l_orderkey").alias("imdb_tconst")).agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "people"))).alias("crew"))
    return P.flat_credits(files).select(F.col("imdb_tconst").alias("title"), "role", "pos", F.col("nconst").alias("key"))


@query("SELECT url FROM pages")
def p11_sitemap(spark, sf_dir):
    row = F.concat(F.lit("<url><loc> "), "url", F.lit("\n</loc></url>"))
    return P.sitemap(joined(read(spark, sf_dir, "pages"), "page_id div 20", "page_id", row, "<urlset>", "</urlset>", "text"))


# ---- readers: files that Spark writes from a table first
def _files(spark, df, group: str, column: str = "value") -> str:
    """A text file a group, under the shared folder."""
    folder = new_path(spark, "files")
    df.repartition(F.col(group)).write.partitionBy(group).text(folder)
    return folder


def _a_file_a_row(spark, df, key: str, folders: int = 64) -> str:
    """A text file a row, in a bounded number of folders: the writer cuts files by rows, so no row needs a folder of its own. Rows are
    dealt by their key, a folder a task, so no task has several folders while others have none."""
    folder = new_path(spark, "files")
    rows = df.repartition(folders, key).select(F.spark_partition_id().alias("folder"), "value")
    rows.write.partitionBy("folder").option("maxRecordsPerFile", 1).text(folder)
    return folder


@query("SELECT p_name AS title, p_size AS year, p_brand AS director FROM part")
def s3_staged_productions(spark, sf_dir):
    """JSON lists, several hundred records a file."""
    row = F.struct(F.col("p_name").alias("title"), F.col("p_size").alias("year"), F.col("p_brand").alias("director"))
    lists = read(spark, sf_dir, "part").groupBy(F.expr("p_partkey div 500").alias("g")).agg(F.to_json(F.collect_list(row)).alias("value"))
    return tables.glob_records(spark, f"{_a_file_a_row(spark, lists, 'g')}/*/*.txt", tables.PRODUCTIONS).select("title", "year", "director")


@query("SELECT p_size AS year, p_name AS project_title, p_type AS family, p_partkey AS amount_isk FROM part WHERE p_size % 2 = 0")
def s2_staged_ledger(spark, sf_dir):
    """Several lists and one that is absent."""
    row = F.struct(F.col("p_size").alias("year"), F.col("p_name").alias("project_title"), F.col("p_type").alias("family"), F.col("p_partkey").alias("amount_isk"))
    lists = read(spark, sf_dir, "part").groupBy((F.col("p_size") % 4).alias("g")).agg(F.to_json(F.collect_list(row)).alias("value"))
    folder = _files(spark, lists, "g")
    return tables.records(spark, [f"{folder}/g=0", f"{folder}/g=nowhere", f"{folder}/g=2"], tables.LEDGER).select("year", "project_title", "family", "amount_isk")


@query("SELECT s_suppkey AS id, '2020-01-02' AS date, s_name || ' & co' AS title, '<p>' || s_name || '</p>' AS html FROM supplier")
def s6_posts(spark, sf_dir):
    """A JSON object a file."""
    post = F.struct(F.col("s_suppkey").alias("id"), F.lit("2020-01-02T03:04:05").alias("date"), F.struct(F.concat(F.lit("<b>"), "s_name", F.lit("</b> &amp; co")).alias("rendered")).alias("title"), F.struct(F.concat(F.lit("<p>"), "s_name", F.lit("</p>")).alias("rendered")).alias("content"))
    files = read(spark, sf_dir, "supplier").select("s_suppkey", F.to_json(post).alias("value"))
    return tables.posts(spark, f"{_a_file_a_row(spark, files, 's_suppkey')}/*/*.txt").select("id", "date", "title", "html")


@query("SELECT 'tt' || s_suppkey AS imdb_tconst, s_name AS title, s_acctbal AS rating FROM supplier WHERE s_suppkey % 5 <> 0")
def s4_entity_files(spark, sf_dir):
    """A JSON object a file; each fifth file is broken and dropped."""
    one = F.to_json(F.struct(F.concat(F.lit("tt"), F.col("s_suppkey").cast("string")).alias("imdb_tconst"), F.col("s_name").alias("title"), F.col("s_acctbal").alias("rating")))
    files = read(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 5 == 0, F.substring(one, 1, 12)).otherwise(one).alias("value"))
    return tables.entity_files(spark, f"{_a_file_a_row(spark, files, 's_suppkey')}/*/*.txt", tables.CREDITS).select("imdb_tconst", "title", "rating")


@query("SELECT p_partkey::VARCHAR AS tconst, p_name AS title, CASE WHEN p_size % 3 <> 0 THEN p_size END AS year FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def s8_filtered_tsv(spark, sf_dir):
    """A gzipped TSV with nulls, reduced at the scan to keys that are known."""
    folder = new_path(spark, "tsv")
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("tconst"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 3 != 0, F.col("p_size")).alias("year"))
    p.write.csv(folder, sep="\t", header=True, nullValue="\\N", quote="", compression="gzip")
    known = read(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").cast("string").alias("tconst"))
    return tables.tsv(spark, folder, "tconst string, title string, year int", "tconst", known)


@query("SELECT md5(html) AS md5, count(*)::BIGINT AS n FROM pages GROUP BY 1")
def s7_mirrored_pages(spark, sf_dir):
    """Whole files, one a page."""
    folder = _a_file_a_row(spark, read(spark, sf_dir, "pages").select("page_id", F.col("html").alias("value")), "page_id")
    return tables.mirrored_pages(spark, f"{folder}/*/*.txt").groupBy(F.md5(F.regexp_replace("text", "\n$", "")).alias("md5")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id::VARCHAR AS id, md5(text) AS md5, source AS type FROM documents")
def s12_chunk_lines(spark, sf_dir):
    folder = new_path(spark, "chunks")
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.create_map(F.lit("type"), "source").alias("metadata"))
    sinks.json_lines(d, folder)
    spark.range(1).select(F.lit("hash").alias("_backend"), F.lit(512).alias("_dim")).write.mode("append").json(folder)
    return tables.chunk_lines(spark, folder).select("id", F.md5("text").alias("md5"), F.col("metadata")["type"].alias("type"))


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_brand FROM part")
def s13_seed_csv(spark, sf_dir):
    folder = new_path(spark, "csv")
    read(spark, sf_dir, "part").write.csv(folder, header=True)
    return tables.seed_csv(spark, folder, ["p_partkey", "p_name", "p_brand"])


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def k1_rebuild(spark, sf_dir):
    """Written twice: a rebuild leaves one copy."""
    folder = new_path(spark, "rebuild")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    for _ in range(2):
        sinks.rebuild({"orders": o}, folder)
    return spark.read.parquet(f"{folder}/orders.parquet")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def k6_json_lines(spark, sf_dir):
    folder = new_path(spark, "json")
    sinks.json_lines(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), folder)
    return spark.read.schema("c_custkey long, c_name string, c_acctbal double").json(folder)


@query("SELECT event_type AS metric, sum(value::DECIMAL(18,2))::DOUBLE AS value FROM events WHERE event_id % 3 = 1 GROUP BY 1")
def k8_snapshots(spark, sf_dir):
    """Three runs' metrics in partitions of their own; the one before the last is read back."""
    folder, e = new_path(spark, "snapshots"), read(spark, sf_dir, "events")
    for k in range(3):
        sinks.snapshot(e.filter(F.col("event_id") % 3 == k).groupBy(F.col("event_type").alias("metric")).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value")), folder, str(k))
    return sinks.previous(spark, folder, "2")


@query("SELECT string_agg(p_partkey || ',' || p_name, chr(10) ORDER BY p_partkey) AS csv FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 100)")
def k9_capped_csv(spark, sf_dir):
    """The first hundred rows as text: the cap is the feature."""
    text = sinks.capped_csv(read(spark, sf_dir, "part").select("p_partkey", "p_name").orderBy("p_partkey"), 100)
    return spark.createDataFrame([(text.split("\n", 1)[1].rstrip("\n"),)], "csv string")


# ---- entity operators
TITLES = "t AS (SELECT min(p_partkey) AS id, p_name AS norm FROM part GROUP BY p_name)"


def _titles(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy(F.col("p_name").alias("norm")).agg(F.min("p_partkey").alias("id"))


@query(f"WITH {TITLES}, m AS (SELECT p_partkey AS m, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN 'myndin ' || p_name || ' vann' ELSE 'zz ' || p_brand END AS raw FROM part), n AS (SELECT m, trim(regexp_replace(lower(raw), '[^0-9a-záéíóúýþæöð]+', ' ', 'g')) AS ln FROM m), h AS (SELECT m, id, row_number() OVER (PARTITION BY m ORDER BY ln <> norm, id) AS k FROM n JOIN t ON ln = norm OR (length(ln) >= 5 AND length(norm) >= 5 AND (contains(ln, norm) OR contains(norm, ln)))) SELECT m.m, id AS title_id FROM m LEFT JOIN h ON h.m = m.m AND k = 1")
def j17_resolved_titles(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    raw = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).when(F.col("p_size") % 3 == 1, F.concat(F.lit("myndin "), "p_name", F.lit(" vann"))).otherwise(F.concat(F.lit("zz "), "p_brand"))
    return corpus.resolve_titles(p.select(F.col("p_partkey").alias("m"), raw.alias("raw")), _titles(spark, sf_dir))


@query("SELECT p.p_partkey AS m, s_suppkey AS person_id FROM part p LEFT JOIN supplier ON s_suppkey = p_partkey % 150 + (CASE WHEN p_partkey % 150 IN (SELECT s_suppkey FROM supplier) THEN 0 ELSE 1000000 END)")
def j18_resolved_people(spark, sf_dir):
    """The first candidate name that is known: a stranger stands before each."""
    names = F.array(F.concat(F.lit("Stranger "), "p_name"), F.format_string("Supplier#%09d", F.col("p_partkey") % 150))
    people = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), X.name_norm("s_name").alias("norm"))
    return corpus.resolve_people(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("m"), names.alias("names")), people)


@query("SELECT DISTINCT l_suppkey AS person_id, 'nm' || l_suppkey AS nconst, CASE l_linenumber WHEN 1 THEN 'director' WHEN 2 THEN 'writer' ELSE 'producer' END AS role FROM lineitem WHERE l_linenumber <= 3 AND l_suppkey % 2 = 0")
def j8_key_roles(spark, sf_dir):
    n = F.col("l_linenumber")
    role = F.when(n == 1, "director").when(n == 2, "writer").when(n == 3, "producer").otherwise("cast")
    credits = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("title_id"), F.col("l_suppkey").alias("person_id"), role.alias("role"))
    people = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("nm"), F.col("s_suppkey").cast("string"))).alias("nconst"))
    return graph.key_roles(people, credits)


@query("WITH l AS (SELECT o_custkey AS norm, year(o_orderdate)::INT AS year, arg_max('tt' || o_orderkey, o_orderkey) AS near FROM orders GROUP BY 1, 2), f AS (SELECT o_custkey AS norm, arg_min('tt' || o_orderkey, o_orderkey) AS far FROM orders GROUP BY 1) SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'own' ELSE coalesce(near, far) END AS tconst FROM customer LEFT JOIN l ON l.norm = c_custkey AND l.year = 1990 + c_custkey % 10 LEFT JOIN f ON f.norm = c_custkey")
def j19_linked_titles(spark, sf_dir):
    k = F.col("c_custkey")
    titles = read(spark, sf_dir, "customer").select(k.alias("id"), k.cast("string").alias("norm"), (1990 + k % 10).cast("int").alias("year"), F.when(k % 4 == 0, "own").alias("imdb"))
    links = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("norm"), F.year("o_orderdate").alias("year"), F.concat(F.lit("tt"), F.col("o_orderkey").cast("string")).alias("tconst"), F.col("o_orderkey").alias("ord"))
    return spine.link_titles(titles, links).select("id", "tconst")


@query("SELECT p_partkey::VARCHAR AS key, CASE WHEN p_size % 5 = 0 THEN 'not_in_imdb' WHEN p_size % 3 = 0 THEN 'TITLE_MISMATCH' ELSE 'ok' END AS status FROM part")
def j25_verified_titles(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    theirs = p.filter("p_size % 5 <> 0").select(F.col("p_partkey").cast("string").alias("key"), F.when(F.col("p_size") % 3 == 0, "zzz").otherwise(F.concat(F.lit("The "), "p_name")).alias("primary"), F.lit("yyy").alias("original"))
    return spine.verify_titles(p.select(F.col("p_partkey").cast("string").alias("key"), F.col("p_name").alias("title")), theirs)


@query("SELECT c_custkey AS id, min(CASE WHEN o_orderpriority <> '5-LOW' THEN year(o_orderdate) END)::INT AS career_first_feature_year FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def e9_career_starts(spark, sf_dir):
    """Orders as careers: a role a priority, one of them without features."""
    o = read(spark, sf_dir, "orders").withColumn("y", F.when(F.col("o_orderpriority") != "5-LOW", F.year("o_orderdate")))
    role = o.groupBy("o_custkey", "o_orderpriority").agg(F.struct(F.min("y").alias("first_feature_year"), F.lit(None).cast("string").alias("first_feature_tconst"), F.lit(None).cast("string").alias("first_feature_title"), F.count("y").cast("int").alias("feature_count"), F.count(F.lit(1)).cast("int").alias("credit_count")).alias("r"))
    careers = role.groupBy(F.col("o_custkey").cast("string").alias("nconst")).agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "r"))).alias("roles"))
    people = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").cast("string").alias("nconst"))
    return spine.career_starts(people, careers).select("id", "career_first_feature_year")


@query("SELECT p_partkey AS id, coalesce(CASE WHEN p_size % 4 <> 0 THEN p_brand END, CASE WHEN p_size % 3 <> 0 THEN p_type END, p_name) AS recipient FROM part")
def x48_recipient(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.coalesce(F.when(F.col("p_size") % 4 != 0, F.col("p_brand")), F.when(F.col("p_size") % 3 != 0, F.col("p_type")), "p_name", F.lit("—")).alias("recipient"))


@query("SELECT p_partkey AS id, CASE WHEN p_brand = (SELECT min(p_brand) FROM part) THEN (SELECT max(p_brand) FROM part) ELSE p_brand END AS brand FROM part")
def x3_redirected_norms(spark, sf_dir):
    """A chain of redirects from the smallest brand over a middle name to the largest."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"))
    ends = p.agg(F.min("brand").alias("a"), F.max("brand").alias("z"))
    steps = ends.select(F.inline(F.array(F.struct(F.col("a").alias("src"), F.lit("middle").alias("dst")), F.struct(F.lit("middle").alias("src"), F.col("z").alias("dst")))))
    return entities.apply_redirects(p, "brand", entities.redirects(spark, steps)).select("id", "brand")


@query("WITH n AS (SELECT l_suppkey AS person, count(*) AS n FROM lineitem GROUP BY 1) SELECT person, CASE WHEN n > (SELECT avg(n) FROM n) THEN 'flagged' ELSE 'busy' END AS layer FROM n")
def e12_flagged_layer(spark, sf_dir):
    n = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("person")).agg(F.count(F.lit(1)).alias("n"))
    mean = n.agg(F.avg("n").alias("m"))  # one row
    busy = n.crossJoin(F.broadcast(mean)).filter("n > m").select("person")
    return graph.with_flagged(n.select("person", F.lit("busy").alias("layer")), busy)


@query("SELECT o_custkey AS id, min(o_orderkey) AS keep, max(o_orderkey) AS gone, 0.9::DOUBLE AS score FROM orders GROUP BY 1 HAVING count(*) > 1 ORDER BY 1")
def e14_records(spark, sf_dir):
    """A pair of orders a customer: the earlier one ranks higher and stays."""
    o = read(spark, sf_dir, "orders")
    pairs = o.groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderkey").alias("a"), F.min("o_orderkey").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("a", "b", F.lit(0.9).alias("score"), F.lit(1).alias("shared"), "id")
    ents = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("name"), (-F.col("o_orderkey")).alias("early"))
    got = entities.merge_records("order", pairs.drop("id"), ents, ["early"])
    return got.join(o.select(F.col("o_orderkey").alias("keep"), F.col("o_custkey").alias("id")), "keep").select("id", "keep", F.col("drop").alias("gone"), "score")
