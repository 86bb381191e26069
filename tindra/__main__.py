"""Command line: packs of a curated folder, and chunks, index and search over them.

python -m tindra packs CURATED OUT | chunk CURATED OUT | index OUT | search OUT WORDS...
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import catalog, chunks, retrieval
from .plans import packs
from .sources import sinks, tables


def load(spark: SparkSession, folder: str) -> dict:
    """The catalog's tables from a folder of curated files; rebate and process are there if their files are."""
    raw = {name: tables.curated(spark, folder, name) for name in ("sources", "grant_families", "grant_streams", "grant_amounts", "documents", "criteria")}
    for name, schema in (("rebate", tables.REBATE), ("process", tables.PROCESS)):
        if tables.exists(spark, f"{folder}/{name}.json"):
            raw[name] = tables.document(spark, f"{folder}/{name}.json", schema)
    return catalog.build(raw, tables.default_meta(spark, folder, "grant_streams"))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tindra")
    sub = parser.add_subparsers(dest="what", required=True)
    for name in ("packs", "chunk"):
        p = sub.add_parser(name)
        p.add_argument("curated")
        p.add_argument("out")
    sub.add_parser("index").add_argument("out")
    p = sub.add_parser("search")
    p.add_argument("out")
    p.add_argument("words", nargs="+")
    p.add_argument("-k", type=int, default=5)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.what == "packs":
        t = load(spark, args.curated)
        sinks.json_lines(packs.json_pack({k: v for k, v in t.items() if k != "warnings"}), f"{args.out}/pack.json")
        sinks.markdown(packs.catalog(t["grant_families"], t["grant_streams"]), f"{args.out}/catalog.md")
        packs.stream_briefs(t["grant_streams"], t["stream_documents"]).write.mode("overwrite").partitionBy("stream_id").text(f"{args.out}/streams")
    elif args.what == "chunk":
        sinks.json_lines(chunks.build(load(spark, args.curated)), f"{args.out}/chunks.json")
    elif args.what == "index":
        retrieval.store(spark.read.schema("id string, text string, metadata map<string,string>").json(f"{args.out}/chunks.json"), f"{args.out}/index")
    else:
        stored = retrieval.load(spark, f"{args.out}/index")
        for r in retrieval.search(stored, " ".join(args.words), args.k).select("score", "id", F.left("text", F.lit(80)).alias("text")).collect():  # k rows
            print(f"{r.score:.4f}  {r.id}  {r.text}")


if __name__ == "__main__":
    main()
