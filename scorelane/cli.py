"""Command line: train, score, sweep. Bare --config trains; --strict ends with 2 unless the run or the batch is fine."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

import yaml
from pyspark.sql import SparkSession

from scorelane import api
from scorelane.operators import store


def _arguments(argv: Sequence[str]) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="scorelane")
    commands = top.add_subparsers(dest="command", required=True)
    t = commands.add_parser("train")
    t.add_argument("--config", required=True)
    t.add_argument("--set", action="append", default=[], metavar="PATH=VALUE")
    s = commands.add_parser("score")
    s.add_argument("--bundle", required=True)
    s.add_argument("--data", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--threshold", type=float)
    s.add_argument("--top-pct", type=float)
    w = commands.add_parser("sweep")
    w.add_argument("--config", nargs="+", required=True)
    for p in (t, s, w):
        p.add_argument("--strict", action="store_true")
    return top.parse_args(["train", *argv] if argv and argv[0].startswith("--config") else argv)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _arguments(sys.argv[1:] if argv is None else argv)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "train":
        run = api.train(spark, a.config, overrides={k: yaml.safe_load(v) for k, _, v in (x.partition("=") for x in a.set)})
        print(run.report.line())
        return 0 if run.ok or not a.strict else 2
    if a.command == "score":
        _, report = api.score(spark, a.bundle, a.data, a.out, a.threshold, a.top_pct)
        print(json.dumps(store.safe(report)))
        return 0 if report["guard"]["safe"] or not a.strict else 2
    out = api.run_sweep(spark, a.config).collect()
    for r in out:
        print(json.dumps(store.safe(r.asDict())))
    return 0 if all(r["comparable"] for r in out) or not a.strict else 2


if __name__ == "__main__":
    sys.exit(main())
