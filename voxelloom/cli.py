"""Command line: ``python -m voxelloom.cli -cfg analysis.yaml`` or ``--generate-config FILE``."""

from __future__ import annotations

import argparse
import logging


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="voxelloom")
    p.add_argument("-cfg", "--config", help="analysis settings (YAML)")
    p.add_argument("--generate-config", metavar="FILE", help="write a commented template and stop")
    p.add_argument("-l", "--log-level", default="INFO")
    args = p.parse_args(argv)
    logging.basicConfig(level=args.log_level.upper())
    from voxelloom.plans import config
    if args.generate_config:
        config.write_template(args.generate_config)
        return 0
    if not args.config:
        p.error("one of --config and --generate-config is required")
    from pyspark.sql import SparkSession
    from voxelloom.plans.analysis import Analysis
    settings = config.AnalysisConfig.from_yaml(args.config)
    spark = (SparkSession.builder.appName("voxelloom").config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.adaptive.enabled", "true").getOrCreate())
    Analysis(spark, settings).run()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
