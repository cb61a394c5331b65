"""Command line: learn a vocabulary from a table of tokens, or encode one with a learned vocabulary.

    python -m chainloom learn --input events.parquet --chain user_id --order ts event_id --token event_type --steps 100 --out vocabulary
    python -m chainloom encode --input events.parquet --chain user_id --order ts event_id --token event_type --vocabulary vocabulary --out coded
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from chainloom.operators.chains import chains
from chainloom.plans.learn import encode, learn
from chainloom.storage import sweep


def options(args: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="chainloom")
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--input", required=True, help="Parquet table of tokens")
    shared.add_argument("--chain", required=True, help="column that names a token's chain")
    shared.add_argument("--order", required=True, nargs="+", help="columns that order a chain")
    shared.add_argument("--token", required=True, help="column of tokens")
    shared.add_argument("--out", required=True, help="folder of the result, which must not exist")
    modes = parser.add_subparsers(dest="mode", required=True)
    learning = modes.add_parser("learn", parents=[shared])
    learning.add_argument("--steps", type=int, default=100)
    learning.add_argument("--least", type=int, default=2, help="a pair occurs at least this often")
    modes.add_parser("encode", parents=[shared]).add_argument("--vocabulary", required=True)
    return parser.parse_args(args)


def main(args: list[str] | None = None) -> None:
    o = options(args)
    if o.mode == "learn" and o.steps < 1:
        raise SystemExit("--steps must be at least 1")
    spark = SparkSession.builder.appName("chainloom").getOrCreate()
    tokens = chains(spark.read.parquet(o.input), o.chain, o.order, o.token)
    if o.mode == "learn":
        learn(tokens, o.steps, least=o.least)[0].write.parquet(o.out)
    else:
        encode(tokens, spark.read.parquet(o.vocabulary)).write.parquet(o.out)
    sweep(spark, everyone=True)


if __name__ == "__main__":
    main()
