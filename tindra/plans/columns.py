"""Column functions over the given tables. COLUMNS has each function beside the DuckDB expression that computes the same; INPUTS
derives from a table the kind of text that it is made for, in SQL that both engines read alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph
from .ledger import read
from .registry import query


def listed(col):
    return F.array_join(col, "|")


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def pick(by: str, *values: str) -> str:
    """One of the values by the remainder of an integer column."""
    return f"CASE {by} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


LET = X.LETTERS
NORM = f"trim(regexp_replace(regexp_replace(lower(coalesce(x, '')), '\\(.*?\\)', ' ', 'g'), '[^{LET}]+', ' ', 'g'))"
LOOSE = f"trim(regexp_replace(lower(coalesce({{x}}, '')), '[^{LET}]+', ' ', 'g'))"
FORMER = r"(?i)^(.*?)\s*\(\s*áður:?\s*([^)]*).*$"
W = f"[{X.UPPER}][{X.LOWER}]+"

PRICE = "CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS STRING) || '.' || lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS STRING), 3, '0')"
DAY = "lpad(CAST(day(l_shipdate) AS STRING), 2, '0') || '.' || lpad(CAST(month(l_shipdate) AS STRING), 2, '0') || '.' || CAST(year(l_shipdate) AS STRING)"
LINE = "l_orderkey * 10 + l_linenumber"

#: name -> (table, key, x): every row of the table has one.
INPUTS = {
    "DOCUMENTS": ("documents", "doc_id", "text"),
    "PAGES": ("pages", "page_id", "html"),
    "URLS": ("pages", "page_id", "url"),
    "TITLES": ("part", "p_partkey", pick("p_size", "p_name || ' (áður ' || p_brand || ')'", "'– ' || p_name || ' –'", "p_name || ' (Áður: ' || p_type || ') x'", "p_name", "NULL")),
    "FIRMS": ("supplier", "s_suppkey", pick("s_suppkey", "s_name || ' ehf.'", "'HF ' || s_name || ' (sf)'", "s_name || ' slf'", "s_name || ' sessions'")),
    "LABELLED": ("part", "p_partkey", pick("p_size", "p_name || ' Styrkur'", "p_name || ' Vilyrði styrkur'", "p_name || ' (vilyrði skilað)'", "'Ferðastyrkur ' || p_name", "p_name || ' 3'", "' - ' || p_name || '/ '", "'Styrkur'", "NULL")),
    "SUPPORT": ("part", "p_partkey", pick("p_size", "p_name || p_name || p_name || p_name || ' festival á vegum'", "p_name", "p_name || p_name || p_name || p_name || p_name || ' lab og meira'", "p_name || p_name || p_name || p_name || p_name || ' Félag ehf. x'", "p_name || p_name || p_name || p_name || p_name || p_name", "NULL")),
    "PEOPLE": ("part", "p_partkey", pick("p_size", "p_name || ', ' || p_brand || ' & ' || p_type", "p_name || '/' || p_type || ' og  ' || p_name", "'vilyrði, ' || p_name", "p_type || ' (' || p_brand || ')'", "NULL")),
    "MONEY": ("orders", "o_orderkey", f"{PRICE} || ' kr'"),
    "AMOUNTS": ("orders", "o_orderkey", f"{PRICE} || ' kr / ' || CAST(o_custkey % 900 + 1 AS STRING) || '.000.000 og ' || {PRICE}"),
    "FIGURES": ("orders", "o_orderkey", pick("o_orderkey", f"{PRICE} || ' (' || CAST(o_custkey AS STRING) || ')'", "CAST(CAST(floor(o_totalprice * 10) AS BIGINT) AS STRING)", f"'alls ' || {PRICE} || ',5'", "o_orderpriority")),
    "SHARES": ("lineitem", LINE, pick("l_linenumber", "CAST(CAST(floor(l_quantity) AS BIGINT) AS STRING) || ',5 %'", "CAST(l_linenumber AS STRING) || '.25%'", "l_returnflag")),
    "LIGATURES": ("documents", "doc_id", "replace(replace(text, 'ff', 'ﬀ'), 'fi', 'ﬁ')"),
    "WIKI": ("documents", "doc_id", "'[[' || lang || '|' || source || ']] [[' || lang || ']] ' || chr(39) || chr(39) || text || chr(39) || chr(39) || ' <br/>'"),
    "DATES": ("lineitem", LINE, pick("l_linenumber", f"'gefið út ' || {DAY} || ' x'", f"{DAY} || ' og ' || {DAY}", "'x' || CAST(l_linenumber AS STRING)", f"'1' || {DAY}")),
    "YEARS": ("orders", "o_orderkey", pick("o_orderkey", "'Edda ' || CAST(year(o_orderdate) + 15 AS STRING)", "'ekkert ár'", "CAST(o_orderkey AS STRING) || '20201'", "'í 2001 og ' || CAST(year(o_orderdate) AS STRING)")),
    "SECTIONS": ("part", "p_partkey", pick("p_size", "'frettir_' || p_name", "'um_' || p_name", "p_name", "'ahorf'", "'kvikmyndagerd_' || p_name", "'kvikmyndamenning'")),
    "MARKETS": ("part", "p_partkey", pick("p_size", "p_name || ' á heimsvísu'", "p_name || ' Worldwide gross'", "p_name", "NULL")),
    "REVIEWS": ("part", "p_partkey", pick("p_size", "p_brand || ' um ' || p_name", "p_name", "'  ' || p_type || ' um „' || p_name", "'A um B'", "NULL")),
    "AWARDS": ("part", "p_partkey", pick("p_size", "p_name || ' vann edduna'", "'Cannes og ' || p_name", "p_name || ' á Berlinale'", "p_name", "NULL")),
    "ROLES": ("lineitem", LINE, pick("l_partkey", "'director'", "'thanks'", "'cast'", "'editor'", "'producer'", "'stunts'", "NULL")),
    "STAGES": ("part", "p_partkey", pick("p_size", "'Dev'", "p_name", "'DEVELOPMENT'", "NULL")),
    "JUNK": ("part", "p_partkey", pick("p_size", "'* ' || p_name", "'Meðaltal ' || p_name", "p_name", "p_name || p_name || p_name || p_name || p_name || p_name || p_name", "' Samtals ' || p_brand", "NULL")),
    "PRICES": ("orders", "o_orderkey", "CASE WHEN o_orderkey % 7 = 0 THEN 0 WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(floor(o_totalprice * 100) AS BIGINT) END"),
    "KEYS": ("part", "p_partkey", pick("p_size", "CAST(p_partkey AS STRING)", "''", "NULL")),
    "WORDS": ("part", "p_partkey", "replace(p_name || ' ' || upper(p_name) || ' ' || p_brand || ' ' || lower(p_brand) || ' ' || p_type, ' ', ',')"),
}

#: name -> (function of the column x, DuckDB expression over x, the input that the query runs on).
COLUMNS = {
    "x1_name_norm": (X.name_norm,
        NORM, "TITLES"),
    "x2_company_norm": (X.company_norm,
        f"trim(regexp_replace(regexp_replace(lower(coalesce(x, '')), '(^|[^{LET}_])(ehf|slf|sf|hf|ses)($|[^{LET}_])', '\\1 \\3', 'g'), '[^{LET}]+', ' ', 'g'))".replace("coalesce(x, '')", "replace(coalesce(x, ''), ' ', '  ')"), "FIRMS"),
    "x5_clean_entity": (X.clean_entity,
        "CASE x WHEN '' THEN '' ELSE (SELECT CASE WHEN n = '' OR regexp_matches(n, '(?i)" + X.DESCRIPTION + "') THEN NULL ELSE n END FROM (SELECT regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(x, '(?i)\\([^)]*(?:vilyr[ðd]i|skila[ðd])[^)]*\\)', ' ', 'g'), '\\s+', ' ', 'g'), '(?i)(^|\\s)((styrkur|styrkir|vilyrði|vilyrdi)[^0-9a-záéíóúýþæöð]*\\s*)+$', '')), '^[ \\-–/.,]+|[ \\-–/.,]+$', '', 'g') AS n)) END", "LABELLED"),
    "x6_clean_title": (lambda x: F.concat_ws("|", X.clean_title(x)["title"], F.array_join(X.clean_title(x)["former"], "/")),
        f"regexp_replace(CASE WHEN regexp_matches(trim(coalesce(x, '')), '{FORMER}') THEN trim(regexp_extract(trim(x), '{FORMER}', 1)) ELSE trim(coalesce(x, '')) END, '^[ \\-–—]+|[ \\-–—]+$', '', 'g') || '|' || CASE WHEN regexp_matches(trim(coalesce(x, '')), '{FORMER}') AND length(trim(regexp_extract(trim(x), '{FORMER}', 2))) > 1 THEN trim(regexp_extract(trim(x), '{FORMER}', 2)) ELSE '' END", "TITLES"),
    "x7_support": (X.is_support,
        "length(coalesce(x, '')) > 45 AND regexp_matches(lower(coalesce(x, '')), '" + X.SUPPORT + "')", "SUPPORT"),
    "x8_people": (lambda x: listed(X.people(x)),
        "array_to_string(list_filter(list_transform(string_split_regex(coalesce(x, ''), '\\s*[,/&]\\s*|\\s+og\\s+'), lambda v: trim(v)), lambda n: n <> '' AND NOT contains(lower(n), 'vilyrði')), '|')", "PEOPLE"),
    "x9_dossier_names": (lambda x: listed(X.dossier_names(x)),
        f"array_to_string(list_filter(list_transform(string_split_regex(coalesce(x, ''), '\\s*[,/&]\\s*|\\s+og\\s+'), lambda v: {LOOSE.format(x='v')}), lambda n: length(n) > 4), '|')", "PEOPLE"),
    "x10_money": (X.money,
        "TRY_CAST(regexp_replace(x, '[^0-9]', '', 'g') AS BIGINT)", "MONEY"),
    "x11_money_tokens": (lambda x: listed(F.transform(X.money_values(x), lambda v: v.cast("string"))),
        r"array_to_string(list_transform(regexp_extract_all(x, '\d{1,3}(?:\.\d{3})+'), lambda m: replace(m, '.', '')), '|')", "AMOUNTS"),
    "x12_amounts": (lambda x: F.concat_ws("|", F.coalesce(X.amounts(x)["amount"].cast("string"), F.lit("-")), F.coalesce(X.amounts(x)["total"].cast("string"), F.lit("-"))),
        r"(SELECT coalesce(d[1], '-') || '|' || coalesce(d[2], '-') FROM (SELECT list_filter(list_transform(regexp_extract_all(coalesce(x, ''), '\d[\d.\s]*\d|\d'), lambda r: regexp_replace(r, '\D', '', 'g')), lambda d: length(d) >= 4) AS d))", "AMOUNTS"),
    "x13_numbers": (lambda x: F.concat_ws("|", F.coalesce(X.leading_int(x).cast("string"), F.lit("-")), F.coalesce(X.admissions(x).cast("string"), F.lit("-"))),
        r"coalesce(regexp_replace(nullif(regexp_extract(x, '(\d[\d.,]*)', 1), ''), '[.,]', '', 'g'), '-') || '|' || coalesce((SELECT v::VARCHAR FROM (SELECT TRY_CAST(regexp_replace(regexp_extract(x, '(\d[\d.,]*)', 1), '[.,]', '', 'g') AS BIGINT) AS v) WHERE v <= 500000), '-')", "FIGURES"),
    "x13_percent": (X.percent,
        r"TRY_CAST(replace(regexp_extract(x, '(\d+(?:[.,]\d+)?)', 1), ',', '.') AS DOUBLE)", "SHARES"),
    "x14_ligatures": (X.plain_ligatures,
        "trim(regexp_replace(replace(replace(replace(replace(replace(x, 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '\\s+', ' ', 'g'))", "LIGATURES"),
    "x16_readable": (X.readable_text,
        r"trim(regexp_replace(regexp_replace(regexp_replace(coalesce(x, ''), '(?is)<(script)\b.*?</script\s*>|<(style)\b.*?</style\s*>|<(noscript)\b.*?</noscript\s*>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))", "PAGES"),
    "x17_strip_tags": (X.strip_tags,
        r"trim(regexp_replace(regexp_replace(coalesce(x, ''), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))", "PAGES"),
    "x18_wikitext": (X.strip_wikitext,
        r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '\[\[[^\]|]*\|([^\]]*)\]\]', '\1', 'g'), '\[\[([^\]]*)\]\]', '\1', 'g'), '''''+', '', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))", "WIKI"),
    "x19_iso_date": (X.iso_date,
        r"CASE WHEN regexp_matches(x, '\b(\d{2})\.(\d{2})\.(\d{4})\b') THEN regexp_replace(regexp_extract(x, '\b\d{2}\.\d{2}\.\d{4}\b'), '(..)\.(..)\.(....)', '\3-\2-\1') ELSE '' END", "DATES"),
    "x20_content_year": (lambda x: X.content_year(x, F.lit(1990)),
        r"coalesce(TRY_CAST(regexp_extract(x, '\b(20\d\d)\b', 1) AS INTEGER), 1990)", "YEARS"),
    "x21_section": (X.section,
        "CASE WHEN starts_with(x, 'ahorf') THEN 'ahorf' WHEN starts_with(x, 'frettir') THEN 'frettir' WHEN starts_with(x, 'kvikmyndamenning') THEN 'kvikmyndamenning' WHEN starts_with(x, 'um') THEN 'um' WHEN starts_with(x, 'kvikmyndagerd') THEN 'kvikmyndagerd' ELSE 'other' END", "SECTIONS"),
    "x22_market_scope": (X.market_scope,
        "CASE WHEN regexp_matches(lower(coalesce(x, '')), 'heimsv|worldwide') THEN 'WW' ELSE 'IS' END", "MARKETS"),
    "x23_review_outlet": (X.review_outlet,
        r"nullif(trim(regexp_extract(x, '(?s)^\s*(.{2,40}?)\s+um\s+\S', 1)), '')", "REVIEWS"),
    "x24_award_word": (X.award_word,
        "(SELECT a FROM (SELECT unnest([" + ", ".join(literal(a) for a in X.AWARD_WORDS) + "]) AS a, generate_subscripts([" + ", ".join(literal(a) for a in X.AWARD_WORDS) + "], 1) AS k) WHERE contains(lower(coalesce(x, '')), lower(a)) ORDER BY k LIMIT 1)", "AWARDS"),
    "x25_name_candidates": (lambda x: listed(X.name_candidates(x)),
        f"array_to_string(regexp_extract_all(coalesce(x, ''), '{W}(?:\\s+{W}){{1,3}}'), '|')", "DOCUMENTS"),
    "x28_layers": (graph.layer_of,
        "CASE x WHEN 'director' THEN 'creative' WHEN 'cast' THEN 'cast' WHEN 'editor' THEN 'tech' WHEN 'producer' THEN 'production' WHEN 'stunts' THEN 'tech' END", "ROLES"),
    "x39_slug": (lambda x: X.slug(x, F.lit(4)),
        "(SELECT CASE WHEN s = '' THEN '4' ELSE s END FROM (SELECT left(regexp_replace(regexp_replace(lower(x), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 120) AS s))", "URLS"),
    "x43_stage_mismatch": (lambda x: X.stage_mismatch(x, F.lit("development")),
        "NOT contains('development', lower(coalesce(x, '')))", "STAGES"),
    "x44_prompt": (lambda x: X.prompt("Project: %s\nBudget: %s", x, F.lit(5)),
        "'Project: ' || coalesce(x, '—') || chr(10) || 'Budget: 5'", "TITLES"),
    "x46_junk_rows": (X.is_junk_row,
        "trim(coalesce(x, '')) = '' OR starts_with(trim(x), '*') OR length(trim(x)) > 60 OR regexp_matches(lower(trim(x)), '^(meðal|samtals|alls|heimild)')", "JUNK"),
    "x47_first_company": (X.first_company,
        "coalesce(trim(string_split(x, '/')[1]), '—')", "PEOPLE"),
    "x27_isk": (X.isk,
        "CASE WHEN x IS NULL OR x = 0 THEN '—' ELSE replace(format('{:,}', x), ',', '.') || ' ISK' END", "PRICES"),
    "f18_portal": (lambda x: X.portal_url(F.lit(""), x, "https://a.example/?id=%s"),
        "CASE WHEN coalesce(x, '') <> '' THEN 'https://a.example/?id=' || x END", "KEYS"),
    "u5_distinct_ignoring_case": (lambda x: listed(X.distinct_ignoring_case(F.split(x, ","))),
        "(SELECT coalesce(string_agg(v, '|' ORDER BY k), '') FROM (SELECT v, k, row_number() OVER (PARTITION BY lower(v) ORDER BY k) AS n FROM (SELECT unnest(string_split(x, ',')) AS v, generate_subscripts(string_split(x, ','), 1) AS k)) WHERE n = 1)", "WORDS"),
}

#: Functions whose results are long texts: their digests are compared.
LONG = {"x14_ligatures", "x16_readable", "x17_strip_tags", "x18_wikitext", "x25_name_candidates"}


def _register(name: str) -> None:
    make, sql, kind = COLUMNS[name]
    table, key, x = INPUTS[kind]
    y = f"md5({sql})" if name in LONG else sql

    @query(f"SELECT k, {y} AS y FROM (SELECT {key} AS k, {x} AS x FROM {table})", name)
    def run(spark, sf_dir):
        df = read(spark, sf_dir, table).select(F.expr(key).alias("k"), F.expr(x).alias("x"))
        return df.select("k", (F.md5(make("x")) if name in LONG else make("x")).alias("y"))


for _name in COLUMNS:
    _register(_name)
