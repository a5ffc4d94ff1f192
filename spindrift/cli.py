"""Command line: ``python -m spindrift.cli run FILE``, ``test FILE``, ``validate FILE``, ``list FOLDER``, ``version``, and ``status``, ``history``, ``lineage``, ``metrics``, ``quarantine`` of a history."""

from __future__ import annotations

import argparse
import logging
import sys
from dataclasses import replace
from pathlib import Path

from spindrift import __version__
from spindrift.errors import ConfigurationError, SpindriftError
from spindrift.settings import settings
from spindrift.spec import RunStatus, from_file


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="spindrift")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, what in (("run", "run a pipeline file"), ("test", "run a pipeline file over some records and load nothing"), ("validate", "look at a pipeline file without running it"), ("list", "name the pipelines of a folder")):
        commands.add_parser(name, help=what).add_argument("path")
    for name in ("run", "test"):
        command = commands.choices[name]
        command.add_argument("--provider", help="a provider's name, or its factory as module:function, in place of the file's")
        command.add_argument("--history", help="a folder that keeps runs, lineage, statuses and failed records")
        command.add_argument("--limit", type=int, default=0, help="the first so many records")
        command.add_argument("--sample", type=float, default=0.0, help="about this share of the records")
    commands.choices["run"].add_argument("--dry-run", action="store_true", help="look at everything without running it")
    for name in ("history", "lineage", "metrics", "quarantine"):
        command = commands.add_parser(name, help=f"show the {name} that a history holds")
        command.add_argument("history")
        command.add_argument("--pipeline")
        command.add_argument("--run-id")
        command.add_argument("--limit", type=int, default=10)
    status = commands.add_parser("status", help="show a run")
    status.add_argument("history")
    status.add_argument("run_id")
    commands.add_parser("version", help="print the version")
    args = parser.parse_args(argv)
    try:
        return _COMMANDS[args.command](args)
    except SpindriftError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.sql.caseSensitive", "true").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _run(args: argparse.Namespace) -> int:
    from spindrift.plans.runner import Runner, summary

    spec = from_file(args.path)
    if args.provider:
        spec = replace(spec, transform=replace(spec.transform, provider=args.provider))
    runner = Runner(spec, history=args.history, limit=args.limit, sample=args.sample, loads=args.command == "run")
    if getattr(args, "dry_run", False):
        return _validate(args)
    spark = _session()
    logging.basicConfig(level=settings(spark).log_level)
    run = runner.run(spark)
    print(summary(run))
    return 0 if run.status in (RunStatus.COMPLETED, RunStatus.PARTIAL) else 1


def _shown(args: argparse.Namespace) -> int:
    """Rows of a table of the history, as JSON lines, the latest runs first."""
    from pyspark.errors import AnalysisException
    from pyspark.sql import functions as F

    from spindrift.plans.history import LINEAGE, RUNS

    spark = _session()
    try:
        runs = spark.read.schema(RUNS).parquet(f"{args.history}/runs")
        runs = runs.where(F.col("pipeline_name") == args.pipeline) if getattr(args, "pipeline", None) else runs
        runs = runs.where(F.col("run_id") == args.run_id) if args.run_id else runs
        if args.command in ("lineage", "quarantine"):
            of = spark.read.schema(LINEAGE).parquet(f"{args.history}/lineage") if args.command == "lineage" else spark.read.parquet(f"{args.history}/quarantine")
            rows = of.join(runs.select("run_id", "started_at"), "run_id").orderBy(F.desc("started_at"), "run_id").drop("started_at")
        else:
            rows = runs.orderBy(F.desc("started_at"), "run_id")
            if args.command == "history":
                rows = rows.select("run_id", "pipeline_name", "status", "started_at", "total_records", "loaded_records", "error_message")
        told = rows.limit(getattr(args, "limit", 1)).toJSON().collect()
    except AnalysisException as e:
        raise ConfigurationError(f"there is no history at {args.history}: {e}") from e
    print("\n".join(told))
    return 0 if told else 1


def _validate(args: argparse.Namespace) -> int:
    spec = from_file(args.path)
    print(f"{spec.name} {spec.version}: {len(spec.evaluate.evaluators)} evaluators, gate {spec.evaluate.quality_gate}")
    return 0


def _list(args: argparse.Namespace) -> int:
    for path in sorted([*Path(args.path).glob("*.yaml"), *Path(args.path).glob("*.yml")]):
        try:
            spec = from_file(path)
            print(f"{path.name}: {spec.name} {spec.version}")
        except SpindriftError as e:
            print(f"{path.name}: {e}")
    return 0


def _version(args: argparse.Namespace) -> int:
    print(__version__)
    return 0


_COMMANDS = {"run": _run, "test": _run, **dict.fromkeys(("status", "history", "lineage", "metrics", "quarantine"), _shown), "validate": _validate, "list": _list, "version": _version}

if __name__ == "__main__":
    sys.exit(main())
