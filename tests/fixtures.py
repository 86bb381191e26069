"""Small documents and tables that the cases run on."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tindra.operators import catalog as C
from tindra.operators import corpus, folds
from tindra.operators import spine as S
from tindra.sources import scratch as scratch_
from tindra.sources import tables as T

_HEAD = "Verkefni            Handritshöfundur     Leikstjóri        Umsækjandi                  Styrkur      Samtals      Vilyrði"
LAYOUT = "\n".join([
    "Framleiðslustyrkir", "", "Leiknar kvikmyndir", _HEAD,
    "Fyrsta myndin       Anna Jónsdóttir      Jón Páll          Mynd ehf. / Sigga Ben       10.000.000   12.000.000",
    "framhald", " " * 20 + "og Bára", "",
    "Önnur mynd          Karl                 Lára              Ljós ehf.                                             5.500.000",
    "Stuttmyndir", _HEAD, "Þriðja              Ö. Ö.                Á. B.             Bíó slf.                    1.234.000",
    "Aðrir styrkir", "Prósi án fjárhæðar", "Ráðstefna um kvikmyndir í Reykjavík á vegum félags        750.000", "stutt 1.000",
])
ARCHIVE = """<h2>Framleiðslustyrkir:</h2><h3>Leiknar kvikmyndir - 2017</h3><table><tr><th>Verkefni</th><th>Handritshöf.</th><th>Leikstjóri</th><th>Umsækjandi</th><th>Styrkur</th></tr>
<tr><td>M&aacute;l</td><td>A</td><td>B</td><td>C ehf.</td><td>65.000.000/72.800.000</td></tr><tr><td>Samtals</td><td></td><td></td><td></td><td>1.000</td></tr></table>
<h2>Handritsstyrkir</h2><table><tr><td>Verkefni</td><td>Upphæð</td></tr><tr><td>D</td><td>500.000</td></tr></table><table><tr><td>x</td></tr></table>"""
FIGURES = """<table><tr><th>Mynd</th><th>Vikur</th><th>Aðsókn</th><th>Heildaraðsókn</th><th>Tekjur</th></tr>
<tr><td>A</td><td>3</td><td>1.200 (1.100)</td><td>500.001</td><td>90.954.270 kr.</td></tr><tr><td>Mynd</td><td>1</td><td>2</td><td>3</td><td>4</td></tr></table>
<TABLE><tr><td>Kvikmynd</td><td>Aðsókn</td></tr><tr><td>B <b>x</b></td><td>500.000</td></tr></TABLE>
<table><tr><td>Heiti</td><td>Stöð</td><td>Áhorfendur</td><td>Áhorf%</td><td>Þátta</td></tr><tr><td>C</td><td>RÚV</td><td>12,345</td><td>31,5</td><td>8</td></tr><tr><td></td><td>X</td><td>1</td><td>1</td><td>1</td></tr></table>"""
WIKI = """{{Kvikmyndalisti
| titill = [[Hrafninn|Hrafninn flýgur]]
| leikstjóri = [[Hrafn]]
| frumsýnd = 4. febrúar 1984
http://www.imdb.com/title/tt0087432
}}
{{ Kvikmyndalisti
| titill = Tóm
[[1999]]
}}
{|
|-
! Plakat !! Frumsýning !! Kvikmynd
|-
| p
| 2021
| ''Dýrið''
| Valdimar
| http://kvikmyndir.is/mynd/?id=77
|-
| p
| 2020
| hrafninn flýgur
| X
| y
|}"""
SERIES = '<!-- <a href="/mynd/?id=9"><img alt="no"></a> --><a class="x" href="/mynd/?id=5"><b>texti</b></a><a href="/mynd/?id=5"><img alt="Fang&amp;ar"> 2017 Lokið</a><a href="/mynd/?id=5"><img alt="z"></a>'
FIRM = '<h2 class="memberfirmname">Firma &amp; co</h2><p class="memberfirmtext">Gata 1 <a href="https://firma.is">v</a> a.b@firma.is 5551234</p>'
PAGE = '<html><main class="m" id="main"><h1>Tit­ill <i>x</i></h1><p>05.03.2021 Texti</p></main>utan</html>'
LEDGER = "row long, year int, project_title string, family string, format_track string, applicant string, company string, producer string, director string, writer string, amount_isk long, commitment_isk long, source_id string"
#: Benedikt Erlingsson's place among the people of the spine.
BENEDIKT = 1
REFUSED = ("drop table title", "select 1; select 2", "", "WITH a AS (SELECT 1 AS x) INSERT INTO title SELECT * FROM a", "select * from parquet.`/tmp/x`", "select * from elsewhere", "withx")


def docs(spark, body: str, column: str = "html", **more) -> DataFrame:
    return spark.range(1).select(F.lit("d").alias("doc"), F.lit(body).alias(column), *[F.lit(v).alias(k) for k, v in more.items()])


def title_files(spark) -> DataFrame:
    rows = [
        ("tt1", "Hross", 2013, "movie", 7.5, 10, ["Drama"], None, {"director": [("nm1", "Anna", "d", None)], "cast": [("nm2", "Búi", None, None), (None, "Ein", None, None)]}, {"production": [("co1", "Mynd ehf.", None)]}),
        ("tt2", "Fúsi", 2015, "movie", None, None, None, None, {"actor": [("nm2", "Búi Annar", None, None)]}, {"sales": [("co1", "Annað nafn", None)], "specialEffects": [("co2", "Brellur", None)]}),
        ("tt9", "Óþekkt", 2000, "movie", 1.0, 1, None, None, {"cast": [("nm9", "Nobody", None, None)]}, {}),
    ]
    return spark.createDataFrame(rows, T.CREDITS)


def linked(spark) -> DataFrame:
    return spark.createDataFrame([(1, "tt1"), (2, "tt2"), (3, None)], "id long, tconst string")


def known(spark) -> DataFrame:
    return spark.createDataFrame([(1, "Anna", "anna", None), (100, "Karl", "karl", None)], "id long, name string, norm string, nconst string")


def folded(spark) -> dict[str, dict[str, DataFrame]]:
    none = spark.createDataFrame([], "src string, dst string")
    firms = spark.createDataFrame([(9, "mynd")], "id long, norm string")
    files = title_files(spark)
    return {"people": folds.people(linked(spark), files, known(spark), none), "companies": folds.companies(linked(spark), files, firms, none)}


def _ledger(spark) -> DataFrame:
    return spark.createDataFrame([
        (1, 2012, "Hross í oss (áður Hestar)", "framleidsla", "leikin_kvikmynd", None, "Hrossabrestur", "Friðrik", "Benedikt Erlingsson", "Benedikt Erlingsson & Ada", 100, None, "a"),
        (2, 2020, "Ný mynd", "handrit", "stuttmynd", None, "Hrossabrestur films Styrkur", None, "Ada", None, 0, 50, "a"),
        (3, 2020, "Ferðastyrkur vegna þátttöku í hátíð í Berlín á árinu 2020", "annad", None, None, None, None, None, None, 5, None, "a"),
        (4, 2021, "Þriðja", "throun", "heimildamynd", None, "Saga film", None, None, None, 7, None, "a"),
    ], LEDGER)


def spine(spark) -> dict[str, DataFrame]:
    prods = spark.createDataFrame([(1, "Hross í oss", 2013, "film", "Benedikt Erlingsson", "s1"), (2, "Fúsi", 2015, "film", None, "s1"), (3, "Hross í oss", 2014, "film", "X Y", "s2")], "row long, title string, year int, kind string, director string, source string")
    registry = spark.createDataFrame([(1, "Hrossabrestur ehf.", "production"), (2, "Saga", "production")], "row long, name string, type string")
    none = spark.createDataFrame([], "src string, dst string")
    return S.build(prods, registry, _ledger(spark), {"company": none, "person": none, "title": none})


def tables_(spark) -> dict[str, DataFrame]:
    return {**spine(spark), "allocations": _ledger(spark)}


def facts(spark) -> dict[str, DataFrame]:
    titles = spark.createDataFrame([(1, "hross í oss"), (2, "fúsi")], "id long, norm string")
    people = spark.createDataFrame([(9, "jóhann jóhannsson")], "id long, norm string")
    art = spark.createDataFrame([
        (1, "Aðsókn", "<table><tr><td>Mynd</td><td>Aðsókn</td></tr><tr><td>Hross í oss (IS)</td><td>1.000</td></tr><tr><td>*skýring</td><td>1</td></tr></table>", "box_office"),
        (2, "Mbl um „Fúsi“: góð", "", "review"), (3, "Jóhann Jóhannsson hlaut Golden Globe", "", "award"),
    ], "id long, title string, html string, category string")
    return corpus.facts(art, titles, people)


SPECS = "ord int, doc_key string, name_is string, name_en string, purpose string, what_it_must_prove string, format_limit string, naming_convention string, common_weaknesses string, aliases array<string>"


def _specs(spark) -> DataFrame:
    return spark.createDataFrame([(0, "script", "Handrit", "Script", "p", "w", None, None, None, ["handrit að mynd"]), (1, "cv", "Ferilskrá", "CV", "p", "w", None, None, None, None)], SPECS)


def matched(spark) -> DataFrame:
    """Substrings of any case count; the longest alias wins, ties go to the earlier spec."""
    texts = spark.createDataFrame([(1, "HANDRIT AÐ MYND og ferilskrá"), (2, "Ferilskrá leikstjóra"), (3, "Fjárhagsáætlun"), (4, "kvikmyndahandritið")], "id int, text string")
    return C.match_documents(texts, _specs(spark))


def catalog(spark) -> dict[str, DataFrame]:
    meta = T.META
    src = spark.createDataFrame([("src.a",)], "id string")
    fam = spark.createDataFrame([(0, "f1", "Fam", "Family", "p1", (["src.a"], "verified", None, None)), (1, "f2", "B", None, None, (None, None, None, None))], f"ord int, id string, name_is string, name_en string, purpose string, _meta {meta}")
    streams = spark.createDataFrame([(0, "s1", "G1", "Straumur", "Stream", "f1", "film", "dev", 1, 1000000, None, "p", None, None, None, {"a": "b"}, {"required": ["Handrit að mynd", "Fjárhagsáætlun"], "newcomer_extra": ["Ferilskrá"]}, None)], f"ord int, id string, gatta_id string, name_is string, name_en string, family string, format_track string, stage string, level int, max_amount_isk long, amount_basis string, purpose string, payment_split string, portal_url string, notes string, rules map<string,string>, documents map<string,array<string>>, _meta {meta}")
    criteria = spark.createDataFrame([("c", "Gæði", "Quality", "d", "e", "r")], "id string, name_is string, name_en string, description string, evidence_examples string, red_flags string")
    amounts = spark.createDataFrame([("f1", "film", 2020, [1, 2], 3)], "family string, format_track string, year int, parts array<bigint>, total bigint")
    rebate = spark.createDataFrame([("rebate", "Endurgreiðsla", "Rebate", (25, "spend", 35, "large"), ("18", "audit"), [(1, "a", "Umsókn", None, None), (2, "b", "Uppgjör", None, None)], (["src.a"], "verified", None, None))], T.REBATE)
    process = spark.createDataFrame([(("cp", [(1, "p1", "Samningur", "undirritun", 3, None, None, [("Gátlisti", "x")], [("Form", "pdf", "http://p")])], None), ("dep", {"form": "http://f", "rules": "http://r"}, None))], T.PROCESS)
    raw = {"sources": src, "grant_families": fam, "grant_streams": streams, "documents": _specs(spark), "criteria": criteria, "grant_amounts": amounts, "rebate": rebate, "process": process}
    return C.build(raw, default_meta={"sources": ["src.a"], "confidence": "needs_verification"}, portal="https://a.example/?id=%s")


def chunk_tables(spark) -> dict[str, DataFrame]:
    article = spark.createDataFrame([(1, "s", "Frétt", "Stutt grein.", "review", "2020-01-01"), (2, "s", "Tóm", "  ", None, None)], "id long, source string, title string, body string, category string, date string")
    awards = _ledger(spark).filter("amount_isk > 0").withColumn("id", F.col("row")).withColumn("confidence", F.lit(None).cast("string"))
    return {**catalog(spark), "corpus_article": article, "allocations": awards}


def datasets(spark) -> dict[str, DataFrame]:
    return {
        "allocations": spark.createDataFrame([("A", "2020", "1.5", None, "handrit", "src.x"), ("", "2027", "-1", "x", "zzz", "y"), (None, "nope", None, None, None, None)], "project_title string, year string, amount_isk string, commitment_isk string, family string, source_id string"),
        "companies_producers": spark.createDataFrame([("F", 1), ("G", 2)], "name string, is_sik_member int"),
        "lexicon": spark.createDataFrame([("a", "b", "c"), ("a", "", "c")], "is string, en string, category string"),
        "imdb_links": spark.createDataFrame([("tt12", "n", 2000.0), ("x1", "n", 1800.0)], "imdb_tconst string, title_norm string, year double"),
    }


FAILURES = [
    ("allocations", "project_title", "min_length(1)", ""), ("allocations", "project_title", "min_length(1)", None),
    ("allocations", "year", "in_range(2018, 2026)", "2027"), ("allocations", "year", "in_range(2018, 2026)", "nope"),
    ("allocations", "amount_isk", "ge(0)", "-1"), ("allocations", "commitment_isk", "ge(0)", "x"), ("allocations", "family", "isin", "zzz"),
    ("allocations", "source_id", "matches(^src\\.)", "y"), ("allocations", "source_id", "matches(^src\\.)", None),
    ("companies_producers", "is_sik_member", "isin", "2"), ("lexicon", "en", "min_length(1)", ""),
    ("imdb_links", "imdb_tconst", "matches(^tt\\d+$)", "x1"), ("imdb_links", "year", "in_range(1900, 2030)", "1800.0"),
]


def queues(spark) -> tuple[DataFrame, ...]:
    """flags, candidates, decisions, aliases, parked links and awards."""
    return (
        spark.createDataFrame([("open",), ("open",), ("done",)], "status string"),
        spark.createDataFrame([("company",), ("person",), ("person",)], "kind string"),
        spark.createDataFrame([("company", "merged"), ("person", "rejected")], "kind string, decision string"),
        spark.createDataFrame([("unresolved",), ("unresolved",), ("resolved",)], "status string"),
        spark.range(3).toDF("id"),
        spark.createDataFrame([(1,), (None,)], "amount_isk long"),
    )


def awards(spark) -> DataFrame:
    return spark.createDataFrame([(2020, "f", "A", 10.0), (2021, "g", "B", 30.0), (2021, "g", "A", None)], "year int, family string, company string, amount double")


def health(spark) -> tuple[DataFrame, ...]:
    return (
        spark.createDataFrame([("title", 900.0, "OK"), ("grant_streams", 19.0, "FAIL")], "metric string, value double, status string"),
        spark.createDataFrame([("linked", 66.7)], "name string, share double"),
        spark.createDataFrame([("open flags", 2)], "queue string, n long"),
        spark.createDataFrame([("s1", 3, "OK"), ("s2", 0, "WARN")], "id string, files long, status string"),
        spark.createDataFrame([("d", 50.0, 100.0, "WARN")], "metric string, value double, previous double, status string"),
    )


BRIEF = """# Straumur
*Stream*
- Stream: G1
- Family and stage: f1 · dev
- Format: film
- Maximum: 1.000.000 ISK
- Portal: https://a.example/?id=G1
- Confidence: needs_verification
Purpose: p
Rules:
- a: b
Documents:
*Required:*
- Handrit að mynd
- Fjárhagsáætlun
*Newcomer:*
- Ferilskrá"""
_STREAMS = ["| key | stream | stage | maximum |", "|---|---|---|---|", "| G1 | Straumur | dev | 1.000.000 ISK |"]
_FUNDING = ["| year | awards | total |", "|---|---|---|", "| 2020 | 1 | 10 ISK |", "| 2021 | 1 | 30 ISK |", "Most funded: B (30 ISK), A (10 ISK)"]
MASTER = [(x,) for x in ["# Digest", "## Streams", *_STREAMS, "## Rebate", "- 25% general, 35% enhanced", "## Funding", *_FUNDING, "## Process", "1. Samningur — undirritun (3 months)"]]
FULL = [(x,) for x in ["# Knowledge base", "## 1. Grants", "### Fam — Family", "p1", *("###" + BRIEF).split("\n"), "## 2. Documents", "### Ferilskrá (CV)", "- Purpose: p", "- Must prove: w", "### Handrit (Script)", "- Purpose: p", "- Must prove: w", "## 3. Criteria", "### Gæði (Quality)", "d", "- Strength: e", "- Red flags: r", "## 4. Amounts", *_STREAMS, "| family | format | year | parts | total |", "|---|---|---|---|---|", "| f1 | film | 2020 | [1,2] | 3 ISK |", "## 5. Rebate", "- 25% general, 35% enhanced", "## 6. Process", "1. Samningur — undirritun (3 months)", "## 7. Funding", *_FUNDING]]
HEALTH = [(x,) for x in ["# Data health", "1 failures, 2 warnings", "## Checks", "- FAIL grant_streams: 19", "- OK title: 900", "## Coverage", "- linked: 66.7%", "## Queues", "- open flags: 2", "## Sources", "- OK s1: 3 files", "- WARN s2: 0 files", "## Drift", "- WARN d: 50"]]


#: Small files of every kind that the readers take.
FILES = "file://" + str(Path(__file__).with_name("files"))


def scratch(spark) -> str:
    return scratch_.new_path(spark, "cases")
