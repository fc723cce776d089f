"""Command line over a corpus folder: add, list, search, status, mark, remove, export."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession

from lavra.operators import corpus as C
from lavra.sources import readers, writers


def _given(spark: SparkSession, items: list[str]) -> DataFrame:
    out = spark.createDataFrame([], "texto string, fonte string")
    for item in items:
        if os.path.isdir(item):
            out = out.unionByName(readers.read_directory(spark, item))
        elif os.path.exists(item) or "://" in item:
            out = out.unionByName(readers.read_file(spark, item))
        else:
            out = out.unionByName(readers.literal(spark, item))
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="lavra", description=__doc__)
    p.add_argument("--corpus", required=True, help="folder of the corpus table")
    sub = p.add_subparsers(dest="verb", required=True)
    sub.add_parser("add").add_argument("items", nargs="+", help="files, folders or texts")
    sub.add_parser("list").add_argument("--limit", type=int, default=20)
    find = sub.add_parser("search")
    find.add_argument("term")
    find.add_argument("--limit", type=int, default=200)
    sub.add_parser("status")
    for verb in ("mark", "remove"):
        v = sub.add_parser(verb)
        v.add_argument("--id", type=int, action="append", default=[])
        v.add_argument("--fonte")
        v.add_argument("--categoria")
    out = sub.add_parser("export")
    out.add_argument("path")
    out.add_argument("--text", action="store_true")
    out.add_argument("--categoria")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("lavra").getOrCreate()
    if a.verb == "add":
        added, repeated = writers.append_new(spark, _given(spark, a.items), a.corpus)
        print(f"added {added}, already there {repeated}")
        return
    corpus = writers.read_corpus(spark, a.corpus)
    if a.verb == "list":
        C.list_preview(corpus, a.limit).show(a.limit, truncate=False)
    elif a.verb == "search":
        C.search(corpus, "texto", a.term, min(a.limit, 200)).select("id", "texto", "fonte").show(a.limit, truncate=80)
    elif a.verb == "status":
        C.status_totals(corpus).show()
        C.top_groups(corpus, "fonte", 10).show(truncate=False)
        C.count_by(corpus, "categoria").show()
    elif a.verb == "mark":
        if not (a.id or a.fonte or a.categoria):
            p.error("say what to mark")
        done = C.mark_used(corpus, spark.createDataFrame([(i,) for i in a.id], "id long")) if a.id else corpus
        done = C.mark_used(done, source=a.fonte) if a.fonte else done
        done = C.mark_used(done, category=a.categoria) if a.categoria else done
        writers.replace_corpus(spark, done, a.corpus)
    elif a.verb == "remove":
        if not (a.id or a.fonte or a.categoria):
            p.error("say what to remove")
        left = corpus.filter(~corpus.id.isin(a.id)) if a.id else corpus
        left = C.without_source_like(left, a.fonte) if a.fonte else left
        left = C.without(left, "categoria", a.categoria) if a.categoria else left
        writers.replace_corpus(spark, left, a.corpus)
    elif a.text:
        writers.export_text(corpus, a.path, a.categoria)
    else:
        writers.export_json(corpus, a.path, a.categoria)


if __name__ == "__main__":
    main()
