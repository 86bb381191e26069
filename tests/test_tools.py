"""The command line, stored indexes, staged files, and exact medians."""

import json
import statistics

import pytest

from tindra.__main__ import main
from tindra.operators import catalog, ledger, quality, retrieval
from tindra.plans import api
from tindra.sources import tables

from .test_operators import rows


@pytest.fixture()
def curated(tmp_path):
    meta = {"sources": ["src.a"], "confidence": "verified"}
    files = {
        "sources": {"sources": [{"id": "src.a"}]},
        "grant_families": {"families": [{"id": "f1", "name_is": "Fam", "_meta": meta}]},
        "grant_streams": {"_default_meta": meta, "streams": [{"id": "s1", "gatta_id": "G1", "name_is": "Straumur", "family": "f1", "stage": "dev", "documents": {"required": ["Handrit"]}}]},
        "grant_amounts": {"amounts": []},
        "documents": {"documents": [{"doc_key": "script", "name_is": "Handrit", "name_en": "Script"}]},
        "criteria": {"criteria": [{"id": "c", "name_is": "Gæði", "name_en": "Quality"}]},
        "rebate": {"id": "rebate", "rates": {"general_pct": 25}, "producer_strategy": {}, "stages": [], "_meta": meta},
    }
    for name, body in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    return tmp_path


def test_command_line(spark, curated, capsys):
    out = str(curated / "out")
    main(["packs", str(curated), out])
    main(["chunk", str(curated), out])
    main(["index", out])
    main(["search", out, "handrit", "-k", "2"])
    assert "stream:s1" in capsys.readouterr().out
    assert spark.read.text(f"{out}/catalog.md").count() == 2 and spark.read.json(f"{out}/pack.json").filter("name = 'rebate'").count() == 1
    ix = retrieval.load(spark, f"{out}/index")
    assert ix["texts"].count() == spark.read.json(f"{out}/chunks.json").count() and ix["terms"].filter("term = 'handrit'").first().df >= 2


def test_default_meta(spark, curated):
    assert tables.default_meta(spark, str(curated), "grant_streams")["sources"] == ["src.a"] and tables.default_meta(spark, str(curated), "none") is None
    t = catalog.with_default(tables.curated(spark, str(curated), "grant_streams"), {"sources": ["x"], "confidence": "c"})
    assert t.first()._meta.sources == ["x"]
    with pytest.raises(quality.DanglingReference):
        catalog.build({k: tables.curated(spark, str(curated), k) for k in ("sources", "grant_families", "grant_streams", "documents", "criteria", "grant_amounts")}, {"sources": ["src.zzz"]})


def test_medians(spark):
    values = {"a": [5.0, 1.0, 3.0], "b": [2.0, 8.0], "c": [7.0] * 5 + [1.0], "d": [4.0]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("e", None)], "k string, v double").repartition(5)
    assert dict(rows(ledger.medians(df, "k", "v"))) == {k: statistics.median(v) for k, v in values.items()}


def test_repeated_ids_keep_their_lines(spark):
    df = spark.createDataFrame([(1, "Aaaa. Bbbb."), (1, "Cccc."), (None, "Dddd.")], "id long, text string")
    got = rows(retrieval.strip_boilerplate(df, spark.createDataFrame([("Bbbb.",)], "sentence string")))
    assert got == [(1, "Aaaa."), (1, "Cccc."), (None, "Dddd.")]


def test_guard_knows_functions(spark):
    t = {"title": spark.createDataFrame([(1, "a", 2.5)], "id int, name string, x double")}
    for good in ("select upper(name) as n, sum(x) over (partition by id) as s from title", "select case when x between 1 and 3 then round(x) else 0 end as y from title where name like 'a%' and id in (1, 2)", "select count(distinct id) as n, cast(avg(x) as int) as a from title group by name having count(*) > 0 order by 1", "with a as (select explode(split(name, ',')) as w from title) select w, count(*) as n from a group by w", "select id || name as k, x + 1 as y, not (id = 2) as z, name is null as q from title"):
        assert api.run_sql(spark, t, good).count() == 1
    for bad in ("select java_method('java.lang.System', 'getProperty', 'user.home') from title", "select reflect('java.lang.System', 'exit', 0) from title", "select id from title where x > (select max(length(java_method('a', 'b'))) from title)", "select try_reflect('a', 'b') from title", "select input_file_name() from title", "select id from title order by java_method('java.lang.System', 'nanoTime')", "select current_user() from title", "select sum(id) over (order by reflect('a', 'b')) from title", "select * from range(3)", "select * from title, lateral (select reflect('a', 'b') as x)", "select id, max(x) from title group by id having reflect('a', 'b') = 'x'", "select * from title lateral view explode(array(reflect('a', 'b'))) t as v", "select transform(array(1), v -> reflect('a', 'b')) from title", "select spark_catalog.default.f(id) from title", "select secret('x') from title"):
        with pytest.raises(api.NotReadOnly):
            api.run_sql(spark, t, bad)


def test_guard_looks_inside(spark):
    t = {"title": spark.range(3)}
    assert api.run_sql(spark, t, "select * from title where id in (select max(id) from title)").first().id == 2
    for bad in ("select * from title where id in (select id from other)", "select (select count(*) from csv.`/etc/hosts`) as n", "with title2 as (select * from spark_catalog.default.title) select * from title2"):
        with pytest.raises(api.NotReadOnly):
            api.run_sql(spark, t, bad)


def test_a_file_a_row_in_few_folders(spark):
    """Files grow with the rows, folders don't; each file holds one row."""
    from tindra.plans import derived

    folder = derived._a_file_a_row(spark, spark.range(200).selectExpr("id", "concat('row ', id) AS value"), "id", folders=8)
    got = spark.read.text(f"{folder}/*/*.txt", wholetext=True).selectExpr("value", "_metadata.file_path AS path").collect()
    assert sorted(r.value for r in got) == sorted(f"row {i}\n" for i in range(200))
    assert len({r.path for r in got}) == 200 and len({r.path.rsplit("/", 2)[1] for r in got}) <= 8
