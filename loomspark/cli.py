"""Commands: normalize, phonemize, bench, query, evaluate, audit."""

from __future__ import annotations

import argparse
import json
import statistics
import time


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomspark", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("normalize", "phonemize", "bench"):
        command = sub.add_parser(name)
        command.add_argument("text")
        if name == "phonemize":
            command.add_argument("--ipa", action="store_true")
            command.add_argument("-v", "--verbose", action="store_true")
        if name == "bench":
            command.add_argument("--runs", type=int, default=20)
    query = sub.add_parser("query", help="run a registered query over a directory of tables and show its first rows")
    query.add_argument("name")
    query.add_argument("folder")
    query.add_argument("--rows", type=int, default=20)
    golden = sub.add_parser("evaluate", help="score the frontend against a golden set")
    golden.add_argument("path")
    golden.add_argument("--lexicon", help="a TSV of words and readings instead of the default")
    audit = sub.add_parser("audit", help="write the manifest of a corpus of Parquet files")
    audit.add_argument("source")
    audit.add_argument("out")
    audit.add_argument("--text", default="sentence")
    audit.add_argument("--key", default="idx")
    args = parser.parse_args(argv)
    if args.command in ("evaluate", "audit"):
        return _job(args)
    if args.command == "query":
        return _query(args)
    from . import api

    if args.command == "normalize":
        print(api.normalize(args.text))
    elif args.command == "phonemize":
        out = api.Frontend()(api.normalize(args.text))
        print(json.dumps(out, ensure_ascii=False) if args.verbose else api.to_ipa(out["phonemes"]) if args.ipa else out["phonemes"])
    else:
        times = []
        for _ in range(args.runs):
            began = time.perf_counter()
            api.text_to_ids(args.text)
            times.append(time.perf_counter() - began)
        print(f"median {statistics.median(times) * 1000:.3f} ms over {args.runs} runs")
    return 0


def _query(args) -> int:
    from pyspark.sql import SparkSession

    from . import plans

    spark = SparkSession.builder.appName("loomspark").getOrCreate()
    plans.queries()[args.name](spark, args.folder).show(args.rows, truncate=60)
    return 0


def _job(args) -> int:
    from pyspark.sql import SparkSession

    from . import jobs

    spark = SparkSession.builder.appName("loomspark").getOrCreate()
    if args.command == "evaluate":
        jobs.evaluate_golden(spark, args.path, args.lexicon).orderBy("category").show(100, truncate=False)
    else:
        print(jobs.audit(spark, args.source, args.out, args.text, args.key).count(), "rows")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
