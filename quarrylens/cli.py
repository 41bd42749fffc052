"""python -m quarrylens.cli TABLE [--config FILE] [--out DIR]: profiles a CSV or Parquet table."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .config import from_dict
from .plans import workflow
from .sources import tables


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("table")
    p.add_argument("--config", help="a JSON file of settings")
    p.add_argument("--out", default="artifacts/runs", help="a local folder, or a URI of a shared one")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("quarrylens").config("spark.sql.caseSensitive", "true").getOrCreate()
    found = tables.load(spark, a.table)
    settings = json.load(open(a.config)) if a.config else {}
    result = workflow.run(found.frame, from_dict({"dataset_name": found.name} | settings), export=True, base_dir=a.out)
    print(result.folder)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
