"""python -m revulet analyze|check|demo|inspect|connectors|doctor"""

from __future__ import annotations

import argparse
import sys
from dataclasses import fields

from pyspark.sql import functions as F

from .operators.regression import Policy, exit_code
from .plans import render, report, result
from .session import session
from .sources.registry import ConnectorError, ConnectorNotFoundError, Dataset, Source, default_registry
from .sources.store_urls import UnsupportedStoreUrlError, source_ref


def parse_source(spark, url: str) -> Source:
    if url == "demo":
        return Source("demo", "com.demo.pulse")
    ref = spark.range(1).select(source_ref(F.lit(url)).alias("r")).collect()[0].r
    if ref is None:
        raise UnsupportedStoreUrlError(f"{url} is the address of neither store.")
    return Source(ref.store, ref.app_id, ref.country, ref.language, ref.canonical_url)


def dataset(spark, args: argparse.Namespace) -> Dataset:
    """Reviews of a store's address, of `demo`, or of a file or folder of JSON lines or Parquet."""
    if args.input:
        rows = spark.read.parquet(args.input) if args.input.rstrip("/").endswith(".parquet") else spark.read.json(args.input)
        return Dataset({"name": args.input}, rows, {"connector": "file"})
    return report.analyze(spark, parse_source(spark, args.url), default_registry(include_demo=True), {"limit": args.limit})


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="revulet")
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("analyze", "check", "demo", "inspect"):
        one = commands.add_parser(name)
        one.add_argument("url", nargs="?", default="demo")
        one.add_argument("--input", help="JSON lines or Parquet of reviews instead of a store's address")
        one.add_argument("--limit", type=int)
        one.add_argument("--format")
        one.add_argument("--output")
        one.add_argument("--force", action="store_true")
        one.add_argument("--fail-on-insufficient", action="store_true")
        for field in fields(Policy):
            one.add_argument("--" + field.name.replace("_", "-"), type=type(field.default), default=field.default)
    commands.add_parser("connectors")
    commands.add_parser("doctor")
    return out


def main(argv: list[str] | None = None) -> int:
    """0, 1 if the gate fails, 2 for wrong use."""
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    if args.command == "connectors":
        print(render.json_text(default_registry(include_demo=True).list()), end="")
        return 0
    spark = session()
    if args.command == "doctor":
        print(render.json_text({"spark": spark.version, "python": sys.version.split()[0], "time_zone": spark.conf.get("spark.sql.session.timeZone")}), end="")
        return 0
    try:
        if args.command == "inspect":
            print(render.json_text(vars(parse_source(spark, args.url))), end="")
            return 0
        kind = render.resolve_format(args.format, args.output)
        data = dataset(spark, args)
        if args.command == "check":
            policy = Policy(**{f.name: getattr(args, f.name) for f in fields(Policy)})
            gate = report.check(data, policy)
            text = render.gate_markdown(gate) if kind == "md" else render.json_text(result.document(gate).collect())
            render.write_text(text, args.output, args.force)
            return max([exit_code(v.status, args.fail_on_insufficient) for v in gate.verdicts.collect()], default=0)
        found = report.tables(data.reviews)
        if kind == "csv":
            render.write_text(render.csv_text(found["reviews"]), args.output, args.force)
            return 0
        write = {"json": render.report_json, "md": render.report_markdown, "html": render.report_html}[kind]
        render.write_text("".join(write(r) for r in report.document(found).orderBy("source", "app_id").collect()), args.output, args.force)
        return 0
    except (ValueError, FileExistsError, ConnectorNotFoundError) as e:
        print(e, file=sys.stderr)
        return 2
    except ConnectorError as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
