"""python -m skysift COMMAND ...: patches, accuracy, sweeps, indexes, features, and any query of the catalogue, from the command line or by spark-submit."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from skysift.operators import evaluation, models, patches
from skysift.session import session
from skysift.sources import results, tables, vector_index


def main(given: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="skysift")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("patches", help="patch boxes of images (Parquet: image, width, height)")
    one.add_argument("images")
    one.add_argument("out")
    one.add_argument("--method", default="cc", choices=sorted(patches.SCHEMES))
    one = commands.add_parser("accuracy", help="accuracy of answers (JSON lines) by category, subtask and task")
    one.add_argument("answers")
    one.add_argument("out")
    one.add_argument("--subtask", help="only answers of this subtask")
    one = commands.add_parser("query", help="a query of the catalogue")
    one.add_argument("name")
    one.add_argument("tables")
    one.add_argument("out")
    one = commands.add_parser("sweep", help="the table of a folder of result files (.jsonl), with reasons for those that don't count")
    one.add_argument("results")
    one.add_argument("out")
    one.add_argument("--items", type=int, required=True, help="items of the task that a whole file has")
    one = commands.add_parser("index", help="an index of label vectors (Parquet: label_id, vec), made or appended to; out gets the labels that were added")
    one.add_argument("labels")
    one.add_argument("index")
    one.add_argument("out")
    one = commands.add_parser("encode", help="features of texts (Parquet: the key and a column of texts), from a cache that they are written back to; out gets key and vector")
    one.add_argument("texts")
    one.add_argument("cache")
    one.add_argument("out")
    one.add_argument("--key", default="id")
    one.add_argument("--column", default="text")
    one.add_argument("--encoder", default="hashed", choices=sorted(models.ENCODERS))
    args = parser.parse_args(given)
    spark = session()
    if args.command == "patches":
        out = patches.patchify(spark.read.parquet(args.images), args.method)
    elif args.command == "accuracy":
        rows = tables.read_questions(spark, args.answers)
        if args.subtask:
            rows = rows.where(F.col("subtask") == args.subtask)
        out = evaluation.accuracy(evaluation.judged(rows.withColumnsRenamed({"answer_choices": "choices", "ground_truth": "truth"})))
    elif args.command == "sweep":
        out = results.sweep(results.read_results(spark, args.results), args.items)
    elif args.command == "index":
        labels = spark.read.parquet(args.labels)
        if not vector_index.create(labels, args.index):
            vector_index.append(labels, args.index)
        out = labels.select("label_id")
    elif args.command == "encode":
        got = models.features(spark.read.parquet(args.texts), args.cache, [args.key], args.column, args.encoder)
        for r in got.failed.limit(20).collect():
            print(f"{r[args.key]}: {r.error}")
        out = got.vectors
    else:
        from skysift.plans.catalogue import QUERIES

        if args.name not in QUERIES:
            parser.error(f"query {args.name!r}: one of {', '.join(sorted(QUERIES))} is needed")
        out = QUERIES[args.name](spark, args.tables)
    out.write.mode("overwrite").parquet(args.out)


if __name__ == "__main__":
    main()
