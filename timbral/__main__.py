"""python -m timbral {augment,status,clear} ...: batch runs over a table of clips, and their manifests."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from timbral.functions.strategy import check_arguments
from timbral.plans import pipelines
from timbral.sinks.files import Manifest


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="timbral")
    sub = parser.add_subparsers(dest="what", required=True)
    a = sub.add_parser("augment")
    a.add_argument("clips")
    a.add_argument("out")
    a.add_argument("--factors", nargs="+", default=["2x", "3x", "5x", "10x"])
    a.add_argument("--ratio", type=float, default=0.5)
    for name in ("status", "clear"):
        s = sub.add_parser(name)
        s.add_argument("manifest")
        s.add_argument("--total", type=int, default=0)
    args = parser.parse_args(argv)
    if args.what == "augment" and (wrong := check_arguments(args.ratio, args.factors)):
        print("\n".join(wrong))
        return 2
    spark = SparkSession.builder.getOrCreate()
    if args.what == "augment":
        status = pipelines.batch(spark.read.parquet(args.clips), args.out, args.factors, args.ratio)
        print(json.dumps(status))
        return int(any(v != "success" for v in status.values()))
    if args.what == "status":
        print(json.dumps({"percent": Manifest(spark, args.manifest).progress(args.total)}))
    else:
        path = spark._jvm.org.apache.hadoop.fs.Path(args.manifest)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
