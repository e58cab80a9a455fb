"""Command line: ``python -m denspark [-o OUT] [--eps E] [--min-samples M] IN``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from denspark.plans.cluster import dbscan
from denspark.plans.estimator import counts
from denspark.sources.text import read_points, write_labels


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="denspark", description="Cluster the points of a delimited text file.")
    parser.add_argument("input")
    parser.add_argument("-o", "--output")
    parser.add_argument("--eps", type=float, default=1.0)
    parser.add_argument("--min-samples", "--minpts", type=int, default=1)
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("denspark").getOrCreate()
    points = read_points(spark, args.input)
    labelled = dbscan(points, [c for c in points.columns if c != "id"], args.eps, args.min_samples)
    if args.output:
        write_labels(labelled, args.output)
    found = counts(labelled).first()
    print(f"clusters {found['n_clusters']}, noise {found['n_noise']}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
