"""Small inputs worked out by hand: column functions, parsers, builds, surfaces, readers and writers.

`both` applies a column function to given values; its SQL computes the same in DuckDB over the same values. `worked` holds
rows that were worked out by hand from the semantics, where SQL has no means for them (parsers, whole builds).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tindra.functions import text as X
from tindra.operators import chunks, corpus, entities, folds, graph, quality, retrieval, spine
from tindra.operators import parsers as P
from tindra.sources import connector, sinks, tables
from tindra.plans import api, packs
from tindra.plans.columns import COLUMNS, LET, listed, literal

from . import fixtures

#: name -> (DuckDB SQL, what builds the rows).
CASES: dict = {}

_SQL = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def both(name: str, values: list) -> None:
    """One row (i, y) a value: a column function in Spark, its expression in DuckDB, both as the queries over tables have them."""
    make, sql, _ = COLUMNS[name]
    kind = "bigint" if name == "x27_isk" else "string"
    rows = ", ".join(f"({i}, {literal(v)})" for i, v in enumerate(values))
    CASES[name] = (
        f"SELECT i, {sql} AS y FROM (SELECT i::INTEGER AS i, x::{_SQL[kind]} AS x FROM (VALUES {rows}) v(i, x))",
        lambda spark: spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}").select("i", make("x").alias("y")),
    )


def worked(name: str, schema: str, rows: list[tuple], build) -> None:
    """build(spark) -> rows of the schema."""
    fields = [f.split(" ") for f in schema.split(", ")]  # name and type; no session is there yet
    cast = ", ".join(f'c{i}::{_SQL[kind]} AS "{field}"' for i, (field, kind) in enumerate(fields))
    values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)

    CASES[name] = (
        f"SELECT {cast} FROM (VALUES {values}) v({', '.join(f'c{i}' for i in range(len(fields)))})",
        lambda spark: build(spark).select(*[F.col(field).cast(kind).alias(field) for field, kind in fields]),
    )


# ---- text functions

both("x1_name_norm", ["Eternal (áður Love Odyssey)", "Ö-hæð  & Þ!", None, "äü x", "(a) (b) C"])
both("x2_company_norm", ["Mynd ehf.", "HF Ljós (sf)", "sfx slf", None, "Ses ses"])
both("x5_clean_entity", ["Reykjavík Films Styrkur", "Grímur Vilyrði styrkur", "Wonder (vilyrði skilað)", "Ferðastyrkur á hátíð", "Félag 3", "Styrkur", "", None, " - Ab/ ", "Félag á flugmiðum", "Styrkur Films", "ÞÁTTTAKA ynpc"])
both("x6_clean_title", ["Eternal (áður Love Odyssey)", "X (áður: Y", "– Z –", "A (áður B", None, "Mynd (Áður: Önnur mynd) x"])
both("x7_support", ["x" * 50, "y" * 40 + " festival á vegum", "festival", "z" * 45 + " lab og meira", "z" * 45 + " labs", "z" * 45 + " Félag ehf. x", None])
both("x8_people", ["A, B & C/D og E", "vilyrði, F", None, "Jón og  Gunna"])
both("x9_dossier_names", ["Jón Jónsson og Al", None, "Anna (Búi) Ek & Ó"])
both("x10_money", ["1.234 kr", "kr", None, "$ 12,000,000"])
both("x11_money_tokens", ["a 1.000 b 12.345.678 2024 3.5", "", "99.999 kr. og 1.0000"])
both("x12_amounts", ["65.000.000/72.800.000", "2) 1.500", "x", None, "12.345 og 999"])
both("x13_numbers", ["16,116 (14,293)", "90.954.270 kr.", "x", None, "500.000", "500.001"])
both("x13_percent", ["31,5 %", "7", "x", None, "12.25%"])
both("x14_ligatures", ["ﬁ  ﬂ ﬀ", "ﬃx\n ﬄ", "plain"])
both("x16_readable", ["<p>a</p><script>var x = '<b>';</script> b<style>p{}</style>", "<SCRIPT src=x>y</SCRIPT>z  <i>w</i>", None, "no tags", "<noscript>n</noscript> o"])
both("x17_strip_tags", ["<b>a</b> <i>b</i>\n c", None, "1 < 2", "<a href='x'>y</a>"])
both("x18_wikitext", ["[[A|B]] [[C]] ''d'' <br/>e", "'''x''' [[y|z]]"])
both("x19_iso_date", ["gefið út 05.03.2021 x", "x", "1.2.2020", "31.12.1999 og 01.01.2000"])
both("x20_content_year", ["Edda 2019", "ekkert ár", "20201", "í 2001 og 2002"])
both("x21_section", ["frettir_a", "um_x", "zzz", "ahorf", "kvikmyndagerd_b", "kvikmyndamenning"])
both("x22_market_scope", ["Aðsókn á heimsvísu", "HEIMSVEIZLA", "Worldwide gross", "Aðsókn", None])
both("x23_review_outlet", ["Mbl um Hrút: gott", "ekkert", "Fréttablaðið um „X“", "A um B"])
both("x24_award_word", ["vann edduna; Edda 2020 og Cannes", "x", None, "á Berlinale", "Eddan fer"])
both("x25_name_candidates", ["Jóhann Jóhannsson hlaut verðlaun með Ólafi Darra Ólafssyni", None, "Ein Tvær Þrjár Fjórar Fimm", "eitt Nafn"])
worked("x26_headline_subjects", "i int, y string", [(0, "Hross í oss"), (1, "Svartur á leik|DÝRIÐ"), (2, "")], lambda s: s.createDataFrame([(0, "„Hross í oss“ og HROSS Í OSS á RIFF, „hross í oss“"), (1, 'DÝRIÐ og "Svartur á leik" KMÍ'), (2, None)], "i int, x string").select("i", listed(X.headline_subjects("x")).alias("y")))
both("x28_layers", ["director", "thanks", "cast", "editor", "producer", None, "stunts"])
both("x39_slug", ["https://A.is/b?c", "///", "a" * 200, "Ö-x"])
both("x43_stage_mismatch", ["Dev", "x", None, "DEVELOPMENT"])
both("x44_prompt", ["Mynd", None])
both("x46_junk_rows", ["* skýring", "Meðaltal", "Mynd", "x" * 61, None, " Samtals 3", "allt"])
both("x47_first_company", ["A / B", None, "C", "/D"])
both("x27_isk", [1234567, 0, None, 999])
both("f18_portal", ["7", None, ""])
both("u5_distinct_ignoring_case", ["a,B,b,A,c", "x", ""])
worked("x37_text_hooks", "i int, lemmas string, ents string", [(0, "ég|er", ""), (1, "", "")], lambda s: s.createDataFrame([(0, "Ég er"), (1, None)], "i int, x string").select("i", listed(X.hook("lemmas", "x")).alias("lemmas"), listed(X.hook("entities", "x")).alias("ents")))
worked("x48_recipient", "i int, y string", [(0, "a"), (1, "b"), (2, "c"), (3, "—")], lambda s: s.createDataFrame([(0, "a", "b", "c"), (1, None, "b", "c"), (2, None, None, "c"), (3, None, None, None)], "i int, company string, writer string, producer string").select("i", F.coalesce("company", "writer", "producer", F.lit("—")).alias("y")))
worked("x3_redirected_norms", "i int, norm string", [(0, "c"), (1, "z")], lambda s: entities.apply_redirects(s.createDataFrame([(0, "A"), (1, "Z")], "i int, x string").select("i", X.name_norm("x").alias("norm")), "norm", entities.redirects(s, s.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string"))))

# ---- parsers
worked("p1_layout_ledger", "family string, format_track string, project_title string, writer string, company string, producer string, amount_isk bigint, total_isk bigint, commitment_isk bigint, confidence string", [
    ("framleidsla", "leikin_kvikmynd", "Fyrsta myndin framhald", "Anna Jónsdóttir og Bára", "Mynd ehf.", "Sigga Ben", 10000000, 12000000, None, None),
    ("framleidsla", "leikin_kvikmynd", "Önnur mynd", "Karl", "Ljós ehf.", None, None, None, 5500000, None),
    ("framleidsla", "stuttmynd", "Þriðja", "Ö. Ö.", "Bíó slf.", None, 1234000, None, None, None),
    ("annad", None, "Ráðstefna um kvikmyndir í Reykjavík á vegum félags", None, None, None, 750000, None, None, "low"),
], lambda s: P.layout_ledger(fixtures.docs(s, fixtures.LAYOUT, year=2021, source_id="src.x", column="text")))
worked("p2_archive_ledger", "family string, format_track string, project_title string, company string, amount_isk bigint, total_isk bigint", [("framleidsla", "leikin_kvikmynd", "Mál", "C ehf.", 65000000, 72800000), ("handrit", None, "D", None, 500000, None)], lambda s: P.archive_ledger(fixtures.docs(s, fixtures.ARCHIVE, year=2017)))
worked("p3_html_tables", "t int, r int, row string", [(0, 0, "Mynd|Aðsókn"), (0, 1, "Hross|1.000"), (1, 0, "x")], lambda s: fixtures.docs(s, "<table><tr><th>Mynd</th><th>Aðsókn</th></tr><tr><td><b>Hross</b></td><td>1.000</td></tr><tr><td> </td></tr></table><TABLE><tr><td>x</td></tr></TABLE><table></table>").select(F.posexplode(P.tables("html")).alias("t", "rows")).select("t", F.posexplode("rows").alias("r", "cells")).select("t", "r", listed(F.col("cells")).alias("row")))
worked("p4_admissions", "film string, week_admissions bigint, total_admissions bigint, gross_isk bigint, weeks_in_release string", [("A", 1200, None, 90954270, "3"), ("B x", None, 500000, None, None), ("C", None, None, None, None)], lambda s: P.admissions_tables(fixtures.docs(s, fixtures.FIGURES)))
worked("p5_viewership", "title string, channel string, viewers bigint, rating_pct double, episodes bigint", [("C", "RÚV", 12345, 31.5, 8)], lambda s: P.viewership_tables(fixtures.docs(s, fixtures.FIGURES)))
worked("p6_film_lists", "title string, year int, director string, imdb string, kvik_id bigint", [("Hrafninn flýgur", 1984, "Hrafn", "tt0087432", None), ("Tóm", 1999, None, None, 77), ("Dýrið", 2021, "Valdimar", None, 77)], lambda s: P.film_lists(fixtures.docs(s, fixtures.WIKI, column="text"), "film"))
worked("p7_series_list", "kvik_id bigint, title string, year int, status string", [(5, "Fang&ar", 2017, "Lokið")], lambda s: P.series_list(fixtures.docs(s, fixtures.SERIES), "series"))
worked("p8_member_registry", "name string, website string, email string, phone string, address string", [("Firma & co", "https://firma.is", "a.b@firma.is", "5551234", "Gata 1 v")], lambda s: P.member_registry(fixtures.docs(s, fixtures.FIRM)))
worked("p9_site_pages", "name string, section string, title string, date string, year int", [("frettir_a", "frettir", "Titill x", "2021-03-05", 2021), ("um_2019", "um", "um 2019", "", 2019)], lambda s: P.site_pages(s.createDataFrame([("frettir_a", fixtures.PAGE), ("um_2019", "<p>b</p>")], "name string, text string")))
worked("p10_flat_files", "imdb_tconst string, role string, pos int, key string, name string", [("tt1", "director", 0, "nm1", "Anna"), ("tt1", "cast", 0, "nm2", "Búi"), ("tt1", "cast", 1, None, "Ein"), ("tt1", "production", 0, "co1", "Mynd ehf.")], lambda s: P.flat_credits(fixtures.title_files(s)).filter("imdb_tconst = 'tt1'").select("imdb_tconst", "role", "pos", F.col("nconst").alias("key"), "name").unionByName(P.flat_companies(fixtures.title_files(s)).filter("imdb_tconst = 'tt1'").select("imdb_tconst", F.col("kind").alias("role"), "pos", F.col("conmst").alias("key"), "name")))
worked("p11_sitemap", "url string", [("http://a",), ("b",)], lambda s: P.sitemap(s.createDataFrame([("<loc>http://a</loc><loc> b </loc>",)], "text string")))

# ---- spine: E2-E8, E12, J12, J13, J15, J20, J21, J25
worked("e2_companies", "id bigint, name string, norm string, member int, awards bigint, total bigint", [(1, "Hrossabrestur ehf.", "hrossabrestur", 1, 1, 100), (2, "Saga", "saga", 1, 0, 0), (3, "Hrossabrestur films", "hrossabrestur films", 0, 1, 50), (4, "Saga film", "saga film", 0, 1, 7)], lambda s: fixtures.spine(s)["company"])
worked("j15_company_aliases", "name string, company_id bigint, method string, status string", [("Hrossabrestur", 1, "exact_norm", "resolved"), ("Hrossabrestur films", 3, "exact_norm", "resolved"), ("Hrossabrestur films", 1, "fuzzy_contains", "unresolved"), ("Saga film", 4, "exact_norm", "resolved"), ("Saga film", 2, "fuzzy_contains", "unresolved")], lambda s: fixtures.spine(s)["company_alias"])
worked("e3_manual_merges", "name string, id bigint, method string, status string", [("Gamla nafn", 7, "manual_merge", "resolved"), ("b", 7, "manual_merge", "resolved")], lambda s: spine.manual_merges(s.createDataFrame([("a", "c", "Gamla nafn"), ("b", "c", None), ("x", "nobody", None)], "src string, dst string, name string"), s.createDataFrame([(7, "c")], "id long, norm string")))
worked("e4_titles", "id bigint, title string, kind string, matches bigint, total double, confidence string, status string", [(1, "Hross í oss", "film", 1, 100.0, "high", "matched"), (2, "Fúsi", "film", 0, None, "none", "before_window"), (3, "Ný mynd", "short", None, None, None, None), (4, "Þriðja", "documentary", None, None, None, None)], lambda s: fixtures.spine(s)["title"])
worked("e5_title_aliases", "alias string, title_id bigint, method string", [("Hross í oss", 1, "self"), ("Hestar", 1, "former_title"), ("Ný mynd", 3, "self"), ("Þriðja", 4, "self")], lambda s: fixtures.spine(s)["title_alias"])
worked("e5_renamed", "alias string, title_id bigint, method string, status string", [("Gamalt heiti", 2, "renamed_to", "resolved"), ("Eldra", 2, "renamed_to", "resolved")], lambda s: spine.renamed_titles(s.createDataFrame([("gamalt heiti", "Gamalt heiti", 2019), ("eldra", "Eldra", 2018), ("annað", "Annað", 2018)], "norm string, title string, year int"), s.createDataFrame([("gamalt heiti", "fúsi"), ("eldra", "fúsi")], "src string, dst string"), s.createDataFrame([(2, "fúsi")], "id long, norm string")))
worked("e6_awards", "title_id bigint, row bigint, year int, family string, amount bigint", [(1, 1, 2012, "framleidsla", 100), (3, 2, 2020, "handrit", 50), (4, 4, 2021, "throun", 7)], lambda s: fixtures.spine(s)["award"])
worked("e7_credits", "title_id bigint, name string, role string, src int", [(1, "Benedikt Erlingsson", "director", 0), (1, "X Y", "director", 0), (1, "Benedikt Erlingsson", "writer", 1), (1, "Ada", "writer", 1), (1, "Friðrik", "producer", 1), (3, "Ada", "director", 1)], lambda s: fixtures.spine(s)["title_credit"].join(fixtures.spine(s)["person"].select(F.col("id").alias("person_id"), "name"), "person_id"))
worked("a9_people", "name string, roles string, credit_count bigint", [("Benedikt Erlingsson", "director,writer", 2), ("X Y", "director", 1), ("Ada", "director,writer", 2), ("Friðrik", "producer", 1)], lambda s: fixtures.spine(s)["person"])
worked("j13_company_edges", "title_id bigint, company_id bigint", [(1, 1), (3, 3), (4, 4)], lambda s: fixtures.spine(s)["title_company"])
worked("j20_people_fold", "title_id bigint, person_id bigint, role string", [(1, 1, "director"), (1, 101, "cast"), (1, 102, "cast"), (2, 101, "cast")], lambda s: fixtures.folded(s)["people"]["credit"])
worked("e8_people_claims", "id bigint, name string, nconst string", [(1, "Anna", "nm1"), (100, "Karl", None), (101, "Búi", "nm2"), (102, "Ein", None)], lambda s: folds.with_claims(fixtures.known(s), fixtures.folded(s)["people"]["claim"], "nconst"))
worked("j21_company_fold", "title_id bigint, company_id bigint, role string", [(1, 9, "production"), (2, 9, "sales"), (2, 12, "specialEffects")], lambda s: fixtures.folded(s)["companies"]["title_company"])
worked("e8_company_types", "entity bigint, key string, name string, type string, is_new boolean", [(9, "co1", "Mynd ehf.", "production", False), (12, "co2", "Brellur", "vfx", True)], lambda s: fixtures.folded(s)["companies"]["claim"])
worked("e8_title_facts", "id bigint, rating double, votes bigint, genres_json string, enriched boolean", [(1, 7.5, 10, '["Drama"]', True), (2, None, None, "[]", True), (3, None, None, None, False)], lambda s: folds.title_facts(fixtures.linked(s), fixtures.title_files(s)))
worked("e8_rollups", "person_id bigint, roles string, credit_count bigint", [(1, "director,writer", 2), (101, "cast", 2), (102, "cast", 1)], lambda s: folds.rollups(s.createDataFrame([(1, 1, "writer"), (1, 1, "director")], "title_id long, person_id long, role string"), fixtures.folded(s)["people"]["credit"]))
worked("e12_flagged_layer", "person bigint, layer string", [(1, "creative"), (2, "flagged"), (3, "cast")], lambda s: graph.with_flagged(s.createDataFrame([(1, "creative"), (2, "tech"), (3, "cast")], "person long, layer string"), s.createDataFrame([(2,)], "person long")))
worked("j8_key_roles", "person_id bigint, nconst string, role string", [(1, "nm1", "director"), (1, "nm1", "writer")], lambda s: graph.key_roles(s.createDataFrame([(1, "nm1"), (2, None)], "id long, nconst string"), s.createDataFrame([(5, 1, "director"), (6, 1, "director"), (5, 1, "writer"), (5, 1, "cast"), (5, 2, "director")], "title_id long, person_id long, role string")))
worked("j19_linked_titles", "norm string, tconst string", [("a", "tt9"), ("b", "tt2"), ("c", "tt5"), ("d", None)], lambda s: spine.link_titles(s.createDataFrame([("a", 2000, "tt9"), ("b", 2001, None), ("c", 2002, ""), ("d", 2003, None)], "norm string, year int, imdb string"), s.createDataFrame([("a", 2000, "tt1", 1), ("b", 2001, "tt3", 1), ("b", 2001, "tt2", 2), ("c", 1999, "tt5", 1), ("c", 1998, "tt6", 2)], "norm string, year int, tconst string, ord int")))
worked("j25_verified_titles", "key string, status string", [("t1", "ok"), ("t2", "TITLE_MISMATCH"), ("t3", "not_in_imdb")], lambda s: spine.verify_titles(s.createDataFrame([("t1", "Hross í oss"), ("t2", "Fúsi"), ("t3", "X")], "key string, title string"), s.createDataFrame([("t1", "Of Horses and Men", "Hross í oss"), ("t2", "Other", None)], "key string, primary string, original string")))
worked("j26_accepted_titles", "id bigint, tconst string, status string, why string", [(1, "tt2", "linked", None), (1, "tt1", "review", "kind_mismatch"), (2, "tt4", "review", "year_mismatch")], lambda s: spine.accept_titles(s.createDataFrame([(1, "a", 2000, "film"), (2, "b", 2000, "series")], "id long, norm string, year int, kind string"), s.createDataFrame([(1, 0, "tt1", "a", 2000, "tvSeries"), (1, 1, "tt2", "a", 2001, "movie"), (1, 2, "tt3", "z", 2000, "movie"), (2, 0, "tt4", "b", 2005, "tvSeries")], "id long, pos int, tconst string, norm string, year int, kind string"), s.createDataFrame([("tt8",)], "tconst string")))
worked("e9_career_starts", "nconst string, career_first_feature_year int", [("nm1", 1999), ("nm2", None)], lambda s: spine.career_starts(s.createDataFrame([("nm1",), ("nm2",)], "nconst string"), s.createDataFrame([("nm1", "A", {"director": (2005, None, None, 1, 1), "writer": (1999, None, None, 1, 1), "cast": (0, None, None, 0, 1)})], tables.CAREERS)))
worked("e14_records", "kind string, keep_name string, drop_name string, score double, shared bigint", [("company", "Mynd ehf.", "Mynd", 0.93, 2)], lambda s: entities.merge_records("company", s.createDataFrame([(1, 2, 0.93, 2)], "a long, b long, score double, shared long"), s.createDataFrame([(1, "Mynd", 0, 100, 1), (2, "Mynd ehf.", 1, 0, 1)], "id long, name string, member int, isk long, works long"), ["member", "isk", "works"]))

# ---- corpus: J17, J18, E19, E20
worked("e20_admissions", "article_id bigint, film string, total_admissions bigint, title_id bigint, scope string", [(1, "Hross í oss (IS)", 1000, 1, "IS")], lambda s: fixtures.facts(s)["lx_admissions"])
worked("e20_reviews", "article_id bigint, title_id bigint, outlet string, subject string", [(2, 2, "Mbl", "Fúsi")], lambda s: fixtures.facts(s)["lx_review"])
worked("e20_awards", "article_id bigint, person_id bigint, award string", [(3, 9, "Golden Globe")], lambda s: fixtures.facts(s)["lx_award"])
worked("e19_mentions", "article_id bigint, entity_type string, entity_id bigint", [(1, "title", 1), (2, "title", 2), (3, "person", 9)], lambda s: fixtures.facts(s)["corpus_mention"])
worked("j17_resolved_titles", "m int, title_id bigint", [(1, 1), (2, 1), (3, None), (4, 3), (5, None)], lambda s: corpus.resolve_titles(s.createDataFrame([(1, "Hross í oss!"), (2, "Myndin Hross í oss vann"), (3, "Fús"), (4, "Abcd"), (5, None)], "m int, raw string"), s.createDataFrame([(1, "hross í oss"), (2, "fúsi"), (3, "abcd"), (4, "hross í oss og fleira")], "id long, norm string")))
worked("j18_resolved_people", "m int, person_id bigint", [(1, 9), (2, None)], lambda s: corpus.resolve_people(s.createDataFrame([(1, ["Enginn Hér", "Jóhann Jóhannsson", "Ada Ek"]), (2, ["Enginn"])], "m int, names array<string>"), s.createDataFrame([(9, "jóhann jóhannsson"), (8, "ada ek")], "id long, norm string")))
worked("j16_matched_documents", "id int, doc_key string", [(1, "script"), (2, "cv"), (3, None), (4, "script")], lambda s: fixtures.matched(s))

# ---- catalog, packs and query surfaces
worked("h2_warnings", "collection string, record string", [("grant_families", "f2"), ("process", "cp"), ("process", "dep")], lambda s: fixtures.catalog(s)["warnings"])
worked("j10_stream_documents", "requirement string, text string, doc_key string", [("newcomer", "Ferilskrá", "cv"), ("required", "Fjárhagsáætlun", None), ("required", "Handrit að mynd", "script")], lambda s: fixtures.catalog(s)["stream_documents"])
worked("s1_rebate", "id string, general_pct int, enhanced_pct int, regla_18_manuda string, confidence string", [("rebate", 25, 35, "18", "verified")], lambda s: fixtures.catalog(s)["rebate"])
worked("s1_rebate_stages", "rebate_id string, ord int, id string, name_is string", [("rebate", 1, "a", "Umsókn"), ("rebate", 2, "b", "Uppgjör")], lambda s: fixtures.catalog(s)["rebate_stages"])
worked("s1_archive_links", "deposit_id string, link_key string, url string", [("dep", "form", "http://f"), ("dep", "rules", "http://r")], lambda s: fixtures.catalog(s)["film_archive_links"])
worked("q1_list_grants", "id string, family string", [("s1", "f1")], lambda s: api.list_grants(fixtures.catalog(s), "f1"))
worked("q2_get_grant", "requirement string, text string, purpose string", [("required", "Handrit að mynd", "p"), ("required", "Fjárhagsáætlun", None), ("newcomer", "Ferilskrá", "p")], lambda s: api.get_grant(fixtures.catalog(s), "G1")["documents"])
worked("q3_document_spec", "doc_key string, name_en string", [("cv", "CV")], lambda s: api.get_document_spec(fixtures.catalog(s), "ferilsk"))
worked("q4_funding_stats", "awards bigint, total double", [(2, 100.0)], lambda s: api.funding_stats(fixtures.tables_(s), company="HROSSA")["totals"])
worked("q5_top_recipients", "company string, awards bigint, total double", [("Hrossabrestur", 1, 100.0)], lambda s: api.top_recipients(fixtures.tables_(s), 1))
worked("q6_lookup_person", "title string, year int, role string", [("Hross í oss", 2013, "director"), ("Hross í oss", 2013, "writer")], lambda s: api.lookup_person(fixtures.tables_(s), "erlingss")["filmography"])
worked("q6_collaborators", "name string, n bigint", [("Ada", 2), ("Friðrik", 2), ("X Y", 2)], lambda s: api.lookup_person(fixtures.tables_(s), "erlingss")["collaborators"])
worked("q7_lookup_company", "project_title string, year int, amount_isk bigint", [("Hross í oss (áður Hestar)", 2012, 100)], lambda s: api.lookup_company(fixtures.tables_(s), "hrossabr")["projects"])
worked("q7_candidates", "name string, method string", [("Hrossabrestur films", "fuzzy_contains")], lambda s: api.lookup_company(fixtures.tables_(s), "hrossabr")["candidates"])
worked("q8_rebate", "id string, general_pct int", [("rebate", 25)], lambda s: api.get_rebate(fixtures.catalog(s)))
worked("q9_productions", "title string, status string", [("Hross í oss", "matched")], lambda s: api.productions(fixtures.tables_(s), funded="yes"))
worked("q10_search", "id string, type string, mode string", [("doc:script", "document", "hybrid")], lambda s: _back(s, lambda f: retrieval.store(chunks.build(fixtures.catalog(s)), f), lambda f: retrieval.search(retrieval.load(s, f), "Handrit Script", 1)))
worked("q11_dossier", "as string, project_title string, year int, amount_isk bigint", [("writer/director", "Hross í oss (áður Hestar)", 2012, 100)], lambda s: api.person_dossier(fixtures.tables_(s), fixtures.BENEDIKT)["awards"])
worked("q11_markdown", "n bigint, line string", [(0, "# Benedikt Erlingsson"), (1, ""), (2, "- director: 1"), (3, "- writer: 1"), (4, ""), (5, "| year | project | as | amount |"), (6, "|---|---|---|---|"), (7, "| 2012 | Hross í oss (áður Hestar) | writer/director | 100 ISK |")], lambda s: api.dossier_markdown(api.person_dossier(fixtures.tables_(s), fixtures.BENEDIKT)))
worked("q12_profile", "year int, family string, amount bigint, recipient string", [(2012, "framleidsla", 100, "Hrossabrestur")], lambda s: api.production_profile(fixtures.tables_(s), 1)["funding"])
worked("q12_profile_credits", "role string, name string", [("director", "Benedikt Erlingsson"), ("director", "X Y"), ("producer", "Friðrik"), ("writer", "Ada"), ("writer", "Benedikt Erlingsson")], lambda s: api.production_profile(fixtures.tables_(s), 1)["credits"])
worked("q13_overview", "metric string, value double", [("awards", 4.0), ("total", 112.0), ("titles", 4.0), ("people", 4.0), ("companies", 4.0)], lambda s: api.overview(fixtures.tables_(s)))
worked("q13_explorer", "project_title string, company string, amount_isk bigint", [("Hross í oss (áður Hestar)", "Hrossabrestur", 100)], lambda s: api.explore_awards(fixtures.tables_(s), families=["framleidsla"], words="hross"))
worked("q14_guarded_sql", "n bigint", [(4,)], lambda s: api.run_sql(s, fixtures.tables_(s), "WITH a AS (SELECT * FROM title) SELECT count(*) AS n FROM a"))
worked("q14_refused", "sql string, refused boolean", [(q, True) for q in fixtures.REFUSED], lambda s: s.createDataFrame([(q, api.refused(s, fixtures.tables_(s), q)) for q in fixtures.REFUSED], "sql string, refused boolean"))
worked("r1_chunks", "id string, type string, head string", [("criterion:c", "criterion", "Matsþáttur"), ("doc:cv", "document", "Skjal/fylg"), ("doc:script", "document", "Skjal/fylg"), ("process:p1", "process_stage", "Samningsfe"), ("rebate", "rebate", "Endurgreið"), ("stream:s1", "grant_stream", "Straumur ("), ("corpus:1:0", "corpus", "Frétt. Stu"), ("alloc:1", "allocation", "Hross í os"), ("alloc:3", "allocation", "Ferðastyrk"), ("alloc:4", "allocation", "Þriðja (20")], lambda s: chunks.build(fixtures.chunk_tables(s)).select("id", F.col("metadata")["type"].alias("type"), F.left("text", F.lit(10)).alias("head")))
worked("r1_stream_text", "text string", [("Straumur (G1) — f1/dev. Markmið: p. Hámarksupphæð: 1000000. Greiðsluskipting: —. Skilyrði: a: b. Skylt fylgigögn: Handrit að mynd, Fjárhagsáætlun.",)], lambda s: chunks.streams(fixtures.catalog(s)["grant_streams"], fixtures.catalog(s)["stream_documents"]))
worked("h1_dataset_failures", "dataset string, column string, check string, failure_case string", fixtures.FAILURES, lambda s: quality.gate(fixtures.datasets(s)))
worked("h4_review_queues", "queue string, n bigint", [("open flags", 2), ("company candidates", 1), ("person candidates", 2), ("company merged", 1), ("person merged", 0), ("company rejected", 0), ("person rejected", 1), ("unresolved aliases", 2), ("parked links", 3), ("awards without amount", 1)], lambda s: quality.queues(*fixtures.queues(s)))
worked("h5_source_health", "id string, files bigint, status string", [("s1", 1, "OK"), ("s2", 1, "OK"), ("s3", 0, "WARN")], lambda s: quality.source_health(s.createDataFrame([("s1", "data/raw/a/"), ("s2", "data/raw/b"), ("s3", "nowhere"), ("s4", None)], "id string, local_path string"), s.createDataFrame([("data/raw/a/1.html",), ("data/raw/b",)], "path string")))
worked("k5_master", "line string", fixtures.MASTER, lambda s: packs.master(fixtures.catalog(s), fixtures.awards(s)).orderBy("ord"))
worked("k5_full", "line string", fixtures.FULL, lambda s: packs.full(fixtures.catalog(s), fixtures.awards(s)).orderBy("ord"))
worked("k5_brief", "stream_id string, text string", [("s1", fixtures.BRIEF)], lambda s: packs.stream_briefs(fixtures.catalog(s)["grant_streams"], fixtures.catalog(s)["stream_documents"]))
worked("k4_json_pack", "name string, value string", [("families", '{"id":"f1","name":"Fam"}'), ("families", '{"id":"f2","name":"B"}'), ("rebate", '{"id":"rebate","pct":25}')], lambda s: packs.json_pack({"families": fixtures.catalog(s)["grant_families"].select("id", F.col("name_is").alias("name")), "rebate": fixtures.catalog(s)["rebate"].select("id", F.col("general_pct").alias("pct"))}))
worked("k8_health_report", "line string", fixtures.HEALTH, lambda s: packs.health(*fixtures.health(s)).orderBy("ord"))
worked("s16_paged_source", "page int, body string", [(1, '{"id": 1}'), (1, '{"id": 2}'), (2, '{"id": 3}')], lambda s: connector.read_pages(s, "tindra.sources.connector:example_pages", 3))

# ---- sources, from the small files beside this module
FILES = fixtures.FILES
worked("s1_curated", "ord int, id string, title string", [(0, "src.b", None), (1, "src.a", "A")], lambda s: tables.curated(s, FILES, "sources"))
worked("s2_staged_lists", "src int, year int, project_title string, amount_isk bigint", [(0, 2021, "A", 5), (0, 2022, "B", None), (1, 2016, "C", None)], lambda s: tables.records(s, [f"{FILES}/allocations.json", f"{FILES}/allocations_archive.json", f"{FILES}/none.json"], tables.LEDGER))
worked("s3_sorted_glob", "file string, kvik_id bigint, title string", [("productions_films.json", 1, "Hross"), ("productions_series.json", 2, "Fangar")], lambda s: tables.glob_records(s, f"{FILES}/productions_*.json", tables.PRODUCTIONS).orderBy("file", "row"))
worked("s4_entity_files", "imdb_tconst string, title string", [("tt1", "Hross")], lambda s: tables.entity_files(s, f"{FILES}/tt*.json", tables.CREDITS))
worked("s5_companies", "name string, is_sik_member boolean, email string", [("Mynd ehf.", True, None), ("Ljós", None, "a@b.is")], lambda s: tables.records(s, [f"{FILES}/companies_producers.json"], tables.COMPANIES))
worked("s6_posts", "id bigint, date string, title string, html string", [(7, "2020-01-02", "Frétt & fleira", "<p>x</p>")], lambda s: tables.posts(s, f"{FILES}/post_*.json"))
worked("s7_mirrored_pages", "name string, text string", [("frettir", "<h1>Halló</h1>"), ("uth_2017", "<table></table>")], lambda s: tables.mirrored_pages(s, f"{FILES}/*.html"))
worked("s8_filtered_tsv", "tconst string, primaryTitle string, startYear int", [("tt1", "Hross", 2013), ("tt3", 'Y "q', 1999)], lambda s: tables.tsv(s, f"{FILES}/titles.tsv", "tconst string, primaryTitle string, startYear int", "tconst", s.createDataFrame([("tt1",), ("tt3",), ("tt9",)], "k string")))
worked("s10_archive_pages", "name string, year int", [("uth_2017", 2017)], lambda s: tables.archive_pages(s, f"{FILES}/*.html"))
worked("s11_wikitext", "name string, text string", [("films", "{{Kvikmyndalisti}}")], lambda s: tables.whole_texts(s, f"{FILES}/*.wiki"))
worked("s12_chunk_lines", "id string, text string, type string", [("c1", "t", "x")], lambda s: tables.chunk_lines(s, f"{FILES}/chunks.jsonl").withColumn("type", F.col("metadata")["type"]))
worked("s13_seed_csv", "a string, c string", [("1", "3")], lambda s: tables.seed_csv(s, f"{FILES}/seed.csv", ["a", "c"]))
worked("s14_catalog_ddl", "ddl string", [("CREATE TABLE a(x bigint)\nCREATE TABLE b(y string)",)], lambda s: s.createDataFrame([(tables.catalog_ddl({"b": s.createDataFrame([], "y string"), "a": s.createDataFrame([], "x long")}),)], "ddl string"))


# ---- sinks, read back
def _back(spark, write, read):
    """read(folder) after write(folder), each in a folder of its own."""
    folder = fixtures.scratch(spark)
    write(folder)
    return read(folder)


def _two(spark):
    return spark.createDataFrame([(1, "á"), (2, None)], "id long, name string")


worked("k1_rebuild", "id bigint, name string", [(1, "á"), (2, None)], lambda s: _back(s, lambda f: [sinks.rebuild({"t": _two(s)}, f), sinks.rebuild({"t": _two(s)}, f)], lambda f: s.read.parquet(f"{f}/t.parquet")))
worked("k6_json_lines", "id bigint, name string", [(1, "á"), (2, None)], lambda s: _back(s, lambda f: sinks.json_lines(_two(s), f), lambda f: s.read.schema("id long, name string").json(f)))
worked("k7_append_log", "action string, rows string", [("build", "3"), ("build", "4")], lambda s: _back(s, lambda f: [sinks.append_log(s, f, "build", rows=str(n)) for n in (3, 4)], lambda f: s.read.json(f)))
worked("k8_snapshots", "metric string, value double", [("a", 2.0)], lambda s: _back(s, lambda f: [sinks.snapshot(s.createDataFrame([("a", float(n))], "metric string, value double"), f, str(n)) for n in (1, 2, 3)], lambda f: sinks.previous(s, f, "3")))
worked("k9_capped_csv", "csv string", [("id,name\n1,á\n",)], lambda s: s.createDataFrame([(sinks.capped_csv(_two(s).orderBy("id"), 1),)], "csv string"))
worked("k5_markdown_file", "value string", [("# Digest",), ("## Streams",)], lambda s: _back(s, lambda f: sinks.markdown(packs.master(fixtures.catalog(s), fixtures.awards(s)), f), lambda f: s.read.text(f).filter("value in ('# Digest', '## Streams')")))
worked("r3_stored_index", "term string, df bigint, ids bigint", [("kvikmynd", 2, 2), ("um", 1, 1)], lambda s: _back(s, lambda f: retrieval.store(s.createDataFrame([("a", "kvikmynd um"), ("b", "kvikmynd")], "id string, text string"), f), lambda f: retrieval.load(s, f)["terms"].join(retrieval.load(s, f)["postings"].groupBy("term").agg(F.sum(F.size("ids")).alias("ids")), "term")))
worked("q17_flags", "target_type string, flag string, status string, ok boolean", [("title", "wrong", "open", True)], lambda s: quality.flag(s, "title", 1, "x", "wrong").withColumn("ok", F.col("id").rlike(r"^\d{8}T\d{6}-[0-9a-f]{6}$")))
worked("q18_recipes", "kind string, n bigint", [("film", 2), ("short", 1), ("documentary", 1)], lambda s: api.run_sql(s, fixtures.tables_(s), "SELECT kind, count(*) AS n FROM title GROUP BY kind"))
