"""Command line: python -m lightsieve COMMAND ...

  scan DIR [--exclude TABLE [--allow TABLE]] [--out TABLE]
                               files by format and status, without those of a table of paths unless another allows them
  features DIR OUT             technical features of the images under DIR
  select EVENTS OUT [--pct N]  tiered selection from an events table, partitioned by tier
  deliver ROWS GROUPS OUT      a table of photos by path as a delivery in parts, which audit --in-place can repair
  audit DELIVERED GROUPS CATEGORIES OUT [--scores TABLE] [--fix | --dry-run | --in-place] [--json FILE]
                               duplicates, orphans, missing categories and statistics of a delivery; exit code 1 on
                               violations. --fix writes the delivery without surplus duplicates to OUT, --in-place
                               takes them out of the parts of DELIVERED that hold them and leaves its other files alone
  query NAME SF_DIR            a registered query
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from pyspark.sql import functions as F

from lightsieve import config, delivery, sinks
from lightsieve.config import RAW_FORMATS, STANDARD_FORMATS, Selection
from lightsieve.functions import kernels
from lightsieve.operators import audit, lookup, selection
from lightsieve.plans import registry
from lightsieve.session import build_session
from lightsieve.sources import photos


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lightsieve", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, arguments in {"scan": ["dir"], "features": ["dir", "out"], "select": ["events", "out"], "deliver": ["rows", "groups", "out"], "audit": ["delivered", "groups", "categories", "out"], "query": ["name", "sf_dir"]}.items():
        sub = commands.add_parser(name)
        for a in arguments:
            sub.add_argument(a)
        if name == "select":
            sub.add_argument("--pct", type=int, default=None)
            sub.add_argument("--config")
        if name == "scan":
            sub.add_argument("--exclude")
            sub.add_argument("--allow")
            sub.add_argument("--out")
        if name == "audit":
            sub.add_argument("--scores")
            sub.add_argument("--json")
            acting = sub.add_mutually_exclusive_group()
            acting.add_argument("--fix", action="store_true")
            acting.add_argument("--dry-run", action="store_true")
            acting.add_argument("--in-place", action="store_true")
    args = parser.parse_args(argv)
    spark = build_session()
    if args.command == "scan":
        files = photos.scan(spark, args.dir)
        if args.exclude:
            paths = [spark.read.parquet(t).select(lookup.bare_path("path").alias("_path")) if t else None for t in (args.exclude, args.allow)]
            named = files.withColumn("_path", lookup.bare_path("path"))
            allowed = paths[0].limit(0) if paths[1] is None else paths[1]
            files = lookup.scan_excluding(named, "_path", paths[0], allowed, photos.supported(STANDARD_FORMATS, RAW_FORMATS)).drop("_path")
        routed = photos.route(files)
        if args.out:
            routed.write.mode("overwrite").parquet(args.out)
        routed.groupBy("status", "ext").count().orderBy("status", "ext").show(truncate=False)
    elif args.command == "features":
        kernels.features(photos.images(spark, args.dir)).write.mode("overwrite").parquet(args.out)
    elif args.command == "select":
        settings = config.load(spark, args.config)[0] if args.config else Selection()
        settings = settings if args.pct is None else replace(settings, target_pct=args.pct)
        chosen = selection.select_for_delivery(photos.photos_from_events(spark.read.parquet(args.events)), settings)
        sinks.write_categories(chosen, args.out, "tier")
    elif args.command == "deliver":
        rows, groups = spark.read.parquet(args.rows), spark.read.parquet(args.groups).select("path", "group_id").dropDuplicates(["path"])
        delivery.write_delivery(rows.join(groups, "path", "left"), args.out, "group_id")
    elif args.command == "audit":
        return _audit(spark, args)
    else:
        registry.QUERIES[args.name](spark, args.sf_dir).show(50, truncate=False)
    return 0


def _audit(spark, args) -> int:
    delivered, groups, categories = (spark.read.parquet(p) for p in (args.delivered, args.groups, args.categories))
    found = audit.inspect(delivered, groups, categories, config.CATEGORIES)
    counts = {r["check"]: r["count"] for r in found.groupBy("check").count().collect()}  # three checks
    total = sum(counts.values())
    print(f"{'FAIL' if total else 'PASS'}: {total} violations")
    audit.statistics(categories, "category", config.CATEGORIES).orderBy("category").show(truncate=False)
    found.orderBy("check", "item").show(50, truncate=False)
    if args.in_place:
        scores = spark.read.parquet(args.scores) if args.scores else delivered.select("path", F.lit(0.0).alias("score"))
        removed, parts = delivery.fix_in_place(spark, args.delivered, groups, scores, "path", "group_id", "score")
        print(f"removed {removed} in {len(parts)} parts")
    if args.fix or args.dry_run:
        scores = spark.read.parquet(args.scores) if args.scores else delivered.select("path", F.lit(0.0).alias("score"))
        removed = audit.to_remove(delivered, groups, scores, "path", "group_id", "score")
        removed.show(50, truncate=False)
        if args.fix:
            audit.fix(delivered, removed, "path").write.mode("overwrite").parquet(args.out)
    if args.json:
        found.write.mode("overwrite").json(args.json)
    return int(total > 0)


if __name__ == "__main__":
    sys.exit(main())
