"""Command line: packages, bundles, builds and queries."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .plans import registry
from .sources import package, publish, verify


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tramline")
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("validate", help="check a package")
    one.add_argument("package")
    one = sub.add_parser("verify", help="check a bundle")
    one.add_argument("bundle")
    one = sub.add_parser("load", help="load a package as a new build")
    one.add_argument("store")
    one.add_argument("package")
    one = sub.add_parser("activate", help="show a build")
    one.add_argument("store")
    one.add_argument("build", type=int)
    one.add_argument("--publication", default="public")
    one = sub.add_parser("prune", help="drop the data of old builds")
    one.add_argument("store")
    one.add_argument("--publication", default="public")
    one.add_argument("--retain", type=int, default=3)
    one = sub.add_parser("query", help="write a query's rows as Parquet")
    one.add_argument("name", choices=sorted(registry.QUERIES))
    one.add_argument("tables")
    one.add_argument("target")
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("tramline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if a.command == "validate":
            found: object = package.validate_package(spark, a.package).rows
        elif a.command == "verify":
            found = verify.verify_bundle(spark, a.bundle)
        elif a.command == "load":
            valid = package.validate_package(spark, a.package)
            builds = publish.Builds(publish.Store(a.store))
            build = builds.create(valid.manifest["build_key_sha256"], valid.manifest["feed_version"], **publish.facts_of(valid))
            found = {"build": build, "rows": builds.load(spark, build, valid)}
        elif a.command == "activate":
            publish.Builds(publish.Store(a.store)).activate(a.build, a.publication)
            found = {"active": a.build}
        elif a.command == "prune":
            found = {"pruned": publish.Builds(publish.Store(a.store)).prune(spark, a.publication, a.retain)}
        else:
            registry.queries()[a.name](spark, a.tables).write.parquet(a.target)
            found = {"written": a.target}
    except (package.PackageError, publish.LifecycleError, verify.BundleError, ValueError) as error:
        print(error, file=sys.stderr)
        return 1
    print(json.dumps(found, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
