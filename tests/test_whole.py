"""Queries over all rows of their tables, held against plain versions."""

from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F

from tindra.functions import text as X
from tindra.operators import corpus, entities, ledger, spine
from tindra.plans import base as knowledge
from tindra.plans import registry
from tindra.sources import tables

from . import fixtures
from .test_operators import base, rows  # noqa: F401
from .test_queries import plain


def run(spark, sf_dir, name):
    return registry.queries()[name](spark, sf_dir)


def test_all_parts_are_resolved(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").collect()
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_suppkey").distinct().collect()
    first, works = {}, {}
    for r in part:
        first[r.p_name] = min(r.p_partkey, first.get(r.p_name, r.p_partkey))
    entity = {r.p_partkey: first[r.p_name] for r in part}
    for r in lines:
        works.setdefault(entity[r.l_partkey], set()).add(r.l_suppkey)
    name = {i: n for n, i in first.items()}
    assert dict(rows(run(spark, sf_dir, "er_members"), "id", "entity")) == entity and len(entity) == len(part)
    shared = {(a, b): len(works.get(a, set()) & works.get(b, set())) for a, b in combinations(sorted(name), 2)}
    pairs = [p for p in shared if name[p[0]][:4] == name[p[1]][:4] or shared[p] >= 2]
    assert rows(run(spark, sf_dir, "er_block_candidates"), "a", "b") == sorted(pairs, key=str)


def test_by_name(spark):
    e = spark.createDataFrame([(3, "anna"), (1, "anna"), (2, "karl"), (4, None), (5, "")], "id int, name_fold string")
    w = spark.createDataFrame([(3, 7), (1, 7), (1, 8), (2, 9), (4, 9)], "id int, work int")
    one, works, members = entities.by_name(e, w)
    assert rows(one) == [(1, "anna"), (2, "karl")] and rows(works) == [(1, 7), (1, 8), (2, 9)] and rows(members) == [(1, 1), (2, 2), (3, 1)]


def test_all_titles_are_matched(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").collect()
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").collect()
    names = {r.p_name for r in part}
    awards = [(f"{n} {r.n_name.lower()}", 1995 + r.n_nationkey, r.n_nationkey * 100.0) for n in names for r in nations] + [(n, 1999, 50.5) for n in names]
    want = []
    for r in part:
        year = 1990 + r.p_size
        hits = [x for x in awards if (x[0] == r.p_name or (len(r.p_name) >= 5 and len(x[0]) >= 5 and (r.p_name in x[0] or x[0] in r.p_name))) and year - 9 <= x[1] <= year + 1]
        confidence = "none" if not hits else "high" if any(x[0] == r.p_name for x in hits) else "medium"
        status = "matched" if hits else "no_record_in_window" if year >= 2021 else "before_window"
        want.append((r.p_partkey, len(hits), sum(x[2] for x in hits) if hits else None, confidence, status))
    got = rows(run(spark, sf_dir, "title_match_containment"), "l", "matches", "total", "confidence", "status")
    assert got == sorted(want, key=str) and len(got) == len(part)
    assert {"matched", "no_record_in_window"} <= {x[-1] for x in got}


def test_link_titles(spark):
    t = spark.createDataFrame([(1, "fúsi", 2015, None), (2, "fúsi", 2016, ""), (3, "fúsi", None, None), (4, "fúsi", 2015, "tt9"), (5, "x", 2015, None), (6, "y", None, None)], "id int, norm string, year int, imdb string")
    links = spark.createDataFrame([("fúsi", 2014, "tt1", 1), ("fúsi", 2015, "tt2", 2), ("fúsi", 2015, "tt3", 3), ("x", 2015, None, 4), ("y", 2000, "tt4", 5), ("y", None, "tt5", 6)], "norm string, year int, tconst string, ord int")
    assert rows(spine.link_titles(t, links), "id", "tconst") == [(1, "tt3"), (2, "tt1"), (3, "tt1"), (4, "tt9"), (5, None), (6, "tt5")]


def test_accept_titles(spark):
    ours = spark.createDataFrame([(1, "a", 2010, "film"), (2, "a", 2011, None), (3, "s", 2010, "series"), (4, "k", 2010, "short"), (5, "", 2010, "film")], "id long, norm string, year int, kind string")
    found = spark.createDataFrame([
        (1, 0, "tt1", "a", 2011, "movie"), (1, 1, "tt2", "a", 1999, "movie"), (1, 2, "tt3", "a", 2010, "video"), (1, 3, "tt4", "a", 1990, "movie"),
        (2, 0, "tt1", "a", 2011, "movie"), (3, 0, "tt5", "s", 2012, "tvSeries"), (4, 0, "tt6", "k", 2010, "movie"), (4, 1, "tt7", "k2", 2010, "short"),
        (4, 2, "tt8", "k", 2010, "short"), (4, 3, "nm1", "k", 2010, "short"), (5, 0, "tt9", "", 2010, "movie"),
    ], "id long, pos int, tconst string, norm string, year int, kind string")
    used = spark.createDataFrame([("tt8",)], "tconst string")
    want = [(1, "tt2", "review", "year_mismatch"), (1, "tt3", "linked", None), (2, "tt1", "linked", None), (3, "tt5", "linked", None), (4, "tt6", "review", "kind_mismatch")]
    assert rows(spine.accept_titles(ours, found, used), "id", "tconst", "status", "why") == sorted(want, key=str)


def test_manual_merges_and_links_in_the_spine(spark, base):
    _, led = base
    prods = spark.createDataFrame([(1, "Fúsi", 2015, "film", "Anna B", "s1")], "row long, title string, year int, kind string, director string, source string")
    firms = spark.createDataFrame([(1, "Hrossabrestur ehf.", "production")], "row long, name string, type string")
    none = spark.createDataFrame([], "src string, dst string")
    closed = {"title": none, "company": spark.createDataFrame([("old firm", "hrossabrestur", "Old Firm ehf."), ("z", "nobody", "Z")], "src string, dst string, name string"), "person": spark.createDataFrame([("anna", "anna b")], "src string, dst string")}
    links = spark.createDataFrame([("fúsi", 2014, "tt1", 1)], "norm string, year int, tconst string, ord int")
    t = spine.build(prods, firms, led, closed, links)
    assert rows(t["company_alias"].filter("method = 'manual_merge'"), "name", "company_id", "status") == [("Old Firm ehf.", 1, "resolved")]
    assert rows(t["person_alias"]) == [("anna", 1, "manual_merge", "resolved")]
    assert rows(t["title"].filter("tconst is not null"), "norm", "tconst") == [("fúsi", "tt1")]


def test_career_starts(spark):
    people = spark.createDataFrame([(1, "nm1"), (2, "nm2"), (3, None), (4, "nm4")], "id int, nconst string")
    careers = spark.createDataFrame([("nm1", "A", {"director": (2005, None, None, 2, 3), "writer": (2001, None, None, 1, 1), "cast": (None, None, None, 0, 4), "editor": (0, None, None, 0, 1)}), ("nm2", "B", {"cast": (None, None, None, 0, 1)}), ("nm4", "C", {})], tables.CAREERS)
    got = spine.career_starts(people, careers)
    assert rows(got, "id", "career_first_feature_year") == [(1, 2001), (2, None), (3, None), (4, None)]
    assert {r.id for r in got.filter("career_json is not null").collect()} == {1, 2}


def test_allocation_summary(spark):
    a = spark.createDataFrame([("f", "A", 10.0), ("f", "B", 20.0), ("g", "B", 60.0), (None, None, 5.0), ("g", "C", None)], "family string, company string, amount double")
    s = ledger.allocation_summary(a, companies=1)
    assert rows(s["totals"]) == [(95.0, 23.75, 15.0)]
    assert rows(s["by_category"]) == [("f", 30.0), ("g", 60.0)] and rows(s["top_companies"]) == [("B", 80.0)]
    s = ledger.allocation_summary(a.limit(0))
    assert rows(s["totals"]) == [(0.0, 0.0, 0.0)] and s["by_category"].isEmpty() and s["top_companies"].isEmpty()


def test_copies_of_texts_meet_once(spark):
    """Resolution and funding work by text: pairs of texts don't grow with the rows that share them."""
    left = spark.createDataFrame([(i, "myndin hross") for i in range(200)], "m int, ln string")
    right = spark.createDataFrame([(i, "hross") for i in range(100)], "id int, rn string")
    assert rows(entities.contained(left, right), "ln", "rn", "exact") == [("myndin hross", "hross", False)]
    raw = left.select("m", F.when(F.col("m") > 0, F.col("ln")).alias("raw"))
    got = rows(corpus.resolve_titles(raw, right.select("id", F.col("rn").alias("norm"))), "m", "title_id")
    assert got == sorted([(0, None)] + [(i, 0) for i in range(1, 200)], key=str)
    p = spark.createDataFrame([(1, "hross", 2010), (2, "hross", 2010), (3, "hross", None), (4, "annað", 2022)], "l int, ln string, year int")
    a = spark.createDataFrame([(1, "hross", 2010, 1.5), (2, "hross", 2010, None), (3, "hross í oss", 1999, 2.25), (4, "hross", None, 4.0)], "r int, rn string, ryear int, amount double")
    assert rows(entities.funding_matches(p, a), "l", "matches", "total", "years", "confidence", "status") == [(1, 3, 5.5, "2010", "high", "matched"), (2, 3, 5.5, "2010", "high", "matched"), (3, 4, 7.75, "1999,2010", "high", "matched"), (4, 0, None, "", "none", "no_record_in_window")]


def test_repeated_names_are_merged_before_they_are_ranked(spark):
    """Windows and joins of the spine see a name once a spelling and year, not once an award; the earliest row stays."""
    led = spark.range(1, 301).select(F.col("id").alias("row"), F.lit("Mynd").alias("name"), (F.col("id") % 2).alias("year"), F.lit(None).cast("string").alias("kind"))
    assert rows(spine.merged(led), "row", "year") == [(1, 1), (2, 0)]
    assert rows(spine.first_of(spine.merged(led), "name", "row"), "row") == [(1,)]


def test_spellings_are_cleaned_once(spark):
    """Cleaning a ledger costs by its distinct spellings: rows look theirs up, and nothing but a lookup is left to do for a row."""
    some = [None, "", "Hross ehf. (skilað vilyrði)", "Anna B styrkur", "Anna B", "Ferðastyrkur", "Félag 2", " Þór,  Anna "]
    titles = [None, "", "Mynd (áður: Fyrri mynd)", "- Mynd -", "Mynd (2)"]
    led = spark.createDataFrame([(40 * i + 5 * j + k, some[j], some[-j], some[j - 3], some[(i + j) % 8], some[(i + k) % 8], titles[k]) for i in range(2) for j in range(8) for k in range(5)], "row long, company string, applicant string, producer string, director string, writer string, project_title string")
    t, names = X.clean_title("project_title"), {n: X.clean_entity(n) for n in spine.NAMES}
    want = led.select("row", *[x.alias(n) for n, x in names.items()], "project_title", t["title"].alias("title"), t["former"].alias("former"), X.name_norm(t["title"]).alias("norm"), F.when(names["company"].isNotNull(), X.company_norm(names["company"])).alias("cnorm"))
    got = spine.clean_ledger(led)
    assert rows(got, *want.columns) == rows(want) and got.columns[: len(led.columns)] == led.columns
    assert "regexp" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name, built", [
    ("j15_company_aliases", {"company_alias"}),
    ("e5_title_aliases", {"title_alias"}),
    ("q4_funding_stats", set()),
    ("q9_productions", {"title"}),
    ("a9_people", {"person"}),
    ("q13_overview", {"title", "person", "company"}),
    ("q12_profile", {"award"}),
    ("q14_guarded_sql", {"award", "title"}),
])
def test_surfaces_compile_the_tables_they_read(spark, sf_dir, monkeypatch, name, built):
    """A query costs by the tables of the base that it reads: those and the ledger are compiled and written, no others."""
    wrote, rebuild = [], knowledge.sinks.rebuild
    monkeypatch.setattr(knowledge, "_BUILT", {})
    monkeypatch.setattr(knowledge.sinks, "rebuild", lambda tables, folder: (wrote.extend(tables), rebuild(tables, folder)))
    assert not run(spark, sf_dir, name).isEmpty() and sorted(wrote) == sorted({"allocations"} | built)


def test_a_merged_ledger_gives_the_spine_of_its_rows(spark):
    """Equal rows of a ledger meet once, in one pass: all tables but awards are those that the rows give."""
    led = fixtures._ledger(spark)
    more = [led.withColumns({"row": F.col("row") + 10 * i, "year": F.col("year") + i % 2, "amount_isk": F.when(F.col("row") % 4 != i, F.col("amount_isk") + i), "company": F.when(F.lit(i != 2), F.col("company"))}) for i in range(3)]
    led = more[0].unionByName(more[1]).unionByName(more[2])
    prods = spark.createDataFrame([(1, "Hross í oss", 2013, "film", "Benedikt Erlingsson", "s1"), (2, "Hross í oss", 2013, "film", "Benedikt Erlingsson", "s1")], "row long, title string, year int, kind string, director string, source string")
    firms = spark.createDataFrame([(1, "Hrossabrestur ehf.", "production"), (2, "Saga", "production")], "row long, name string, type string")
    none = spark.createDataFrame([], "src string, dst string")
    closed = {"company": none, "person": none, "title": none}
    whole = spine.build(prods, firms, led, closed)
    merged = spine.merged_ledger(led, *spine.GRAINS)
    assert rows(merged.filter("grain = 'company' and company = 'Saga film'"), "year", "unpaid", "row", "n_awards", "amount", "amount_isk") == [(2021, True, 4, 1, None, None), (2022, False, 14, 1, 8, 8)]
    assert rows(merged.groupBy("grain").agg(F.sum("n_awards").alias("n"))) == sorted((g, 12) for g in spine.GRAINS)
    part = spine.Spine(prods, firms, spine.clean_ledger(merged), closed)
    for name in set(part) - {"award"}:
        assert part[name].dtypes == whole[name].dtypes and rows(part[name], *whole[name].columns) == rows(whole[name]), name
    with pytest.raises(ValueError):
        part["award"]


@pytest.mark.parametrize("name", ["e5_title_aliases", "q4_funding_stats", "q9_productions", "a9_people", "q13_overview"])
def test_the_ledger_is_merged_before_it_is_written(spark, sf_dir, tmp_path, monkeypatch, name):
    """Twenty orders for each: what a query writes of the ledger doesn't grow with them, and its result is that of its SQL."""
    read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "part", "supplier")}
    read["orders"] = read["orders"].crossJoin(spark.range(20)).withColumn("o_orderkey", F.col("o_orderkey") + 600000 * F.col("id")).drop("id")
    duck = duckdb.connect()
    for t, df in read.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    monkeypatch.setattr(knowledge, "_BUILT", {})
    df = run(spark, str(tmp_path), name)
    want = duck.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted([tuple(map(plain, r)) for r in df.collect()], key=str) == sorted([tuple(map(plain, r)) for r in want], key=str)
    (built,) = knowledge._BUILT.values()
    assert 2 * spark.read.parquet(f"{built._folder}/allocations.parquet").count() < read["orders"].count()


def test_records_without_a_key_do_not_meet_on_it(spark):
    """Each record is looked up once, by its key or by its norm; a null key is no key to join on."""
    r = spark.createDataFrame([(1, "k1", "anna"), (2, None, "anna"), (3, "k1", "b"), (4, None, "b"), (5, None, None), (6, "k2", "b"), (7, None, "b")], "ord int, key string, norm string")
    got = entities.strong_key_upsert(r)
    assert rows(got) == [(1, 1), (2, 1), (3, 1), (4, 3), (6, 3), (7, 3)]
    assert "LeftOuter" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_whole_texts_list_folders(spark, tmp_path):
    """Files of a pattern are found by their folders: as many paths as folders, and neither deeper files, others nor those beside."""
    from tindra.sources import tables

    for name in ("a/x.txt", "a/y.txt", "a/z.html", "a/deep/v.txt", "b/x.txt", "beside.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    assert sorted(tables.folders(spark, f"{tmp_path}/*")) == [f"file:{tmp_path}/{x}" for x in "ab"]
    got = tables.whole_texts(spark, f"{tmp_path}/*/*.txt")
    assert sorted((r.name, r.text) for r in got.collect()) == [("x", "a/x.txt"), ("x", "b/x.txt"), ("y", "a/y.txt")]
    assert sorted(r.name for r in tables.whole_texts(spark, f"{tmp_path}/a/*.txt").collect()) == ["x", "y"]
    assert [r.text for r in tables.whole_texts(spark, f"{tmp_path}/a/z.html").collect()] == ["a/z.html"]
