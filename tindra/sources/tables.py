"""Readers. Every schema is explicit, so a missing key becomes null; nothing is inferred."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

META = "struct<sources:array<string>,confidence:string,checked_at:string,notes:string>"
#: Curated collections: the key of the list in its file, and its row type.
CURATED = {
    "sources": ("sources", "id string,title string,url string,source_type string,checked_at string,notes string,local_path string,content_sha256 string,fetched_at string"),
    "grant_families": ("families", f"id string,name_is string,name_en string,purpose string,format_tracks array<string>,subtypes array<string>,_meta {META}"),
    "grant_streams": ("streams", f"id string,gatta_id string,name_is string,name_en string,family string,format_track string,stage string,level int,purpose string,max_amount_isk bigint,amount_basis string,payment_split string,notes string,portal_url string,rules map<string,string>,documents map<string,array<string>>,_meta {META}"),
    "grant_amounts": ("amounts", "family string,format_track string,year int,stage_note string,structure string,parts array<bigint>,total bigint,quote string,source string,source_line int,confidence string"),
    "documents": ("documents", "doc_key string,name_is string,name_en string,purpose string,what_it_must_prove string,format_limit string,naming_convention string,common_weaknesses string,aliases array<string>"),
    "criteria": ("criteria", "id string,name_is string,name_en string,description string,evidence_examples string,red_flags string"),
    "lexicon": ("terms", "is string,en string,category string,literal string,note string,src string"),
}
LEDGER = "year int,project_title string,family string,subtype string,format_track string,applicant string,company string,producer string,director string,writer string,amount_isk bigint,total_isk bigint,commitment_isk bigint,commitments_json string,source_id string,raw_line string,confidence string"
PRODUCTIONS = "kvik_id bigint,title string,year int,kind string,status string,director string,imdb string,url string,source string,where_shown array<string>,og_type_hint string"
COMPANIES = "name string,type string,is_sik_member boolean,website string,email string,phone string,address string,source string"
CREDITS = "imdb_tconst string,title string,year int,kind string,rating double,votes bigint,genres array<string>,countries array<string>,crew map<string,array<struct<nconst:string,name:string,job:string,characters:string>>>,companies map<string,array<struct<conmst:string,name:string,notes:string>>>"
CAREERS = "nconst string,name string,roles map<string,struct<first_feature_year:int,first_feature_tconst:string,first_feature_title:string,feature_count:int,credit_count:int>>"
POSTS = "id bigint,date string,slug string,link string,title struct<rendered:string>,content struct<rendered:string>,categories array<int>,tags array<int>"
REBATE = f"id string,name_is string,name_en string,rates struct<general_pct:int,general_basis:string,enhanced_pct:int,enhanced_conditions:string>,producer_strategy struct<regla_18_manuda:string,audit_trail:string>,stages array<struct<order:int,id:string,name_is:string,description:string,stream_id:string>>,_meta {META}"
PROCESS = f"contract_process struct<id:string,stages:array<struct<order:int,id:string,name_is:string,condition:string,deadline_months:int,regulation_ref:string,submit_email:string,checklist:array<struct<title:string,description:string>>,forms:array<struct<title:string,format:string,url:string>>>>,_meta:{META}>,film_archive_deposit struct<id:string,links:map<string,string>,_meta:{META}>"
FLAGS = "id string,ts string,user string,target_type string,target_id string,target_label string,flag string,note string,status string,resolution string"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (globs too) has files, on whatever file system it names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """The folders that a path (globs too) names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return [str(x.getPath()) for x in found or [] if x.isDirectory() and not x.getPath().getName().startswith(("_", "."))]


def curated(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One row per record of a curated collection, in file order (column ord)."""
    key, row = CURATED[name]
    schema = T.StructType([T.StructField(key, T.ArrayType(T._parse_datatype_string(row)))])
    df = spark.read.schema(schema).option("multiLine", True).json(f"{folder}/{name}.json")
    return df.select(F.posexplode(key).alias("ord", "r")).select("ord", "r.*")


def document(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """A curated file that is one object (or holds it under a key), as one row; none if the file is absent."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    read = T._parse_datatype_string(schema) if key is None else T.StructType([T.StructField(key, T._parse_datatype_string(schema))])
    df = spark.read.schema(read).option("multiLine", True).json(path)
    return df if key is None else df.select(f"{key}.*")


def default_meta(spark: SparkSession, folder: str, name: str) -> dict | None:
    """The _default_meta of a curated file, for records without their own; None without one."""
    path = f"{folder}/{name}.json"
    row = spark.read.schema(f"_default_meta {META}").option("multiLine", True).json(path).first() if exists(spark, path) else None
    return row[0].asDict() if row and row[0] else None


def records(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Staged lists of records; absent files are skipped. src and row carry the order in which sources win."""
    out = None
    for k, path in enumerate(paths):
        if not exists(spark, path):
            continue
        df = spark.read.schema(schema).option("multiLine", True).json(path).select(F.lit(k).alias("src"), F.monotonically_increasing_id().alias("row"), "*")
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], f"src int,row bigint,{schema}")


def glob_records(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Files of a glob in the order of their names; the name is the source order."""
    if not exists(spark, pattern):
        return spark.createDataFrame([], f"file string,row bigint,{schema}")
    return spark.read.schema(schema).option("multiLine", True).json(pattern).select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("row"), "*")


def entity_files(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """One JSON object a file; files that don't parse are dropped."""
    bad = "_corrupt"
    df = spark.read.schema(f"{schema},{bad} string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).json(pattern)
    return df.filter(F.col(bad).isNull()).drop(bad)


def whole_texts(spark: SparkSession, pattern: str) -> DataFrame:
    """(name, text): whole files with their stem. Files that a pattern names in folders are found by listing the folders, not file by file
    on the driver."""
    folder, _, last = pattern.rpartition("/")
    found = folders(spark, folder) if folder and re.fullmatch(r"[^{}\[\]\\]*[*?][^{}\[\]\\]*", last) else []
    df = spark.read.text(found, wholetext=True, pathGlobFilter=last) if found else spark.read.text(pattern, wholetext=True)
    return df.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("name"), F.col("value").alias("text"))


def archive_pages(spark: SparkSession, pattern: str) -> DataFrame:
    """Ledger pages whose year stands in the file name."""
    return whole_texts(spark, pattern).withColumn("year", F.regexp_extract("name", r"(\d{4})", 1).try_cast("int")).filter("year is not null")


def mirrored_pages(spark: SparkSession, pattern: str) -> DataFrame:
    return whole_texts(spark, pattern).filter(~F.col("name").isin("sitemap", "manifest", "index"))


def posts(spark: SparkSession, pattern: str) -> DataFrame:
    """Articles of a news site's REST export: the day, the title without tags and entities, and the body."""
    from ..functions.python import maybe_unescape
    from ..functions.text import strip_tags

    df = entity_files(spark, pattern, POSTS)
    return df.select("id", F.substring("date", 1, 10).alias("date"), "slug", "link", F.trim(maybe_unescape(strip_tags(F.col("title.rendered"), ""))).alias("title"), "categories", "tags", F.col("content.rendered").alias("html"))


def tsv(spark: SparkSession, path: str, schema: str, key: str, known: DataFrame) -> DataFrame:
    """A large (gzipped) TSV with \\N for null, reduced at the scan to keys that are known."""
    df = spark.read.schema(schema).csv(path, sep="\t", header=True, nullValue="\\N", quote="")
    return df.join(known.select(F.col(known.columns[0]).alias(key)), key, "left_semi")


def chunk_lines(spark: SparkSession, path: str) -> DataFrame:
    """Chunk or index JSONL; the meta line is skipped."""
    return spark.read.schema("_backend string,id string,text string,metadata map<string,string>,vector array<double>").json(path).filter("_backend is null").drop("_backend")


class MissingColumns(ValueError):
    pass


def seed_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """CSV as strings, reduced to its required columns; raises if one is missing."""
    df = spark.read.csv(path, header=True)
    if missing := [x for x in required if x not in df.columns]:
        raise MissingColumns(f"{path}: {', '.join(missing)}")
    return df.select(*required)


def catalog_ddl(frames: dict[str, DataFrame]) -> str:
    """CREATE TABLE lines of the given tables: the schema text that ad-hoc SQL users see."""
    return "\n".join(f"CREATE TABLE {n}({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in df.schema)})" for n, df in sorted(frames.items()))


def equals_if(column: str, value) -> Column:
    """Equality when a value is given; everything for an empty string, 0 or None."""
    return F.col(column) == value if value else F.lit(True)
