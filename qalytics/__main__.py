"""Command line: ``python -m qalytics refresh SRC [--out DIR]`` runs the
medallion build over the tables in SRC; ``python -m qalytics query NAME SRC
[--out DIR]`` evaluates a registered query and writes it as parquet (or
prints the first rows)."""

from __future__ import annotations

import argparse
import json


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="qalytics")
    sub = ap.add_subparsers(dest="cmd", required=True)
    r = sub.add_parser("refresh", help="land bronze and write silver, gold and marts")
    r.add_argument("src")
    r.add_argument("--out", default=None, help="build folder (default: below spark.checkpoint.dir)")
    q = sub.add_parser("query", help="evaluate a registered query")
    q.add_argument("name")
    q.add_argument("src")
    q.add_argument("--out", default=None, help="write the result as parquet here")
    q.add_argument("--show", type=int, default=20)
    a = ap.parse_args(argv)

    from pyspark.sql import SparkSession

    from qalytics.session import SESSION_DEFAULTS, checkpoint_root

    builder = SparkSession.builder.appName("qalytics")
    for k, v in SESSION_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    checkpoint_root(spark)
    if a.cmd == "refresh":
        from qalytics.plans.medallion import refresh

        timings: dict = {}
        rel = refresh(spark, a.src, a.out, timings=timings)
        print(json.dumps({"root": rel.root, "seconds": timings}))
    else:
        from qalytics.plans.catalog import QUERIES

        df = QUERIES[a.name](spark, a.src)
        if a.out:
            df.write.mode("overwrite").parquet(a.out)
        else:
            df.show(a.show, truncate=False)


if __name__ == "__main__":
    main()
