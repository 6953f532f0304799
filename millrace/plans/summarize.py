"""Command line: summarise an evaluation log as JSON on standard output.

    python -m millrace.plans.summarize LOG.jsonl
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..sources.jsonl import summarize_jsonl, to_sorted_json


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Summarise an evaluation log.")
    parser.add_argument("path", help="JSONL file, folder or pattern")
    parser.add_argument("--exact", action="store_true", help="parse exactly as Python's json module")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    print(to_sorted_json(summarize_jsonl(spark, args.path, exact=args.exact)))


if __name__ == "__main__":
    main()
