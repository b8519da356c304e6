"""Command line: ``python -m spanloom screen ...``."""

from __future__ import annotations

import argparse
import sys

from spanloom.operators.profile import RADIUS
from spanloom.plans.screen import AuditError, Settings, run_screen


def _positive(text: str) -> int:
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError(f"{text} is less than 1")
    return n


def version() -> str:
    from importlib import metadata

    try:
        return metadata.version("spanloom")
    except metadata.PackageNotFoundError:  # run from its folder
        return "0"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="spanloom", description="Screen representatives by the alignments of their cluster.")
    top.add_argument("--version", action="version", version=f"%(prog)s {version()}")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("screen", help="label each representative; nothing is trimmed or clustered")
    p.add_argument("--representatives", required=True, help="FASTA, one id a line (.txt, .ids; also .gz), or Parquet")
    p.add_argument("--alignments", required=True, help="14-column .tsv or .tsv.gz, or normalised Parquet without self hits")
    p.add_argument("--annotations", required=True, help="Parquet, one row for each annotated target, key qseqid")
    p.add_argument("--alternative-layouts", default=None, help="Parquet, optional: layouts of peaks on other queries")
    p.add_argument("--alternative-links", default=None, help="Parquet, optional: targets that link one-sided peaks to other queries")
    p.add_argument("--output-directory", required=True, help="new or empty folder; results are a version below it")
    p.add_argument("--force", action="store_true", help="add a version to results that are there; until it is complete, the version before it is current")
    p.add_argument("--round-integers", action="store_true", help="take decimal numbers for integers in text: 12.6 is 13, 1e2 is 100")
    p.add_argument("--master", default=None, help="Spark master; by default the one that is configured")
    p.add_argument("--threads", type=_positive, default=8, help="shuffle partitions and, without a master, local threads (default %(default)s)")
    p.add_argument("--workers", type=_positive, default=1, help="tasks at a time, without a master, if more than --threads (default %(default)s)")
    p.add_argument("--radius-nt", type=_positive, default=RADIUS, help="window to either side of a coordinate (default %(default)s)")
    p.add_argument("--min-two-sided-peak-score", type=_positive, default=2, help="for local, directional and overlap peaks (default %(default)s)")
    p.add_argument("--min-one-sided-peak-score", type=_positive, default=10, help="for one-sided peaks (default %(default)s)")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.errors import PySparkException
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.appName("spanloom").config("spark.sql.shuffle.partitions", str(args.threads))
    if args.master or SparkSession.getActiveSession() is None:
        builder = builder.master(args.master or f"local[{max(args.threads, args.workers)}]")
    spark = builder.getOrCreate()
    try:
        result = run_screen(spark, representatives=args.representatives, alignments=args.alignments, annotations=args.annotations, output=args.output_directory, settings=Settings(args.radius_nt, args.min_two_sided_peak_score, args.min_one_sided_peak_score), layouts=args.alternative_layouts, links=args.alternative_links, force=args.force, rounding=args.round_integers)
    except (OSError, ValueError, AuditError, PySparkException) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    for action in ("no_selected_boundary", "review", "quarantine"):
        print(f"{action}: {result['representative_action_counts'].get(action, 0)} representatives")
    print(f"Representative actions: {result['representative_actions']}")
    print(f"Quarantine ids: {result['quarantine_query_ids']}")
    print(f"Manifest: {result['version']}/screen.manifest.json")
    return 0
