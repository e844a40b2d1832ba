"""Command line: route references, discover sources, run operators, look into the registry."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from terraloom.model import State
from terraloom.plans.executor import Executor, build_params, coerce, exit_code, get_operator, hydrology_run, materialize
from terraloom.plans.registry import Registry, Run
from terraloom.plans.route import SourceRef, default_router
from terraloom.sources.services import Access, discover_duckdb, discover_files, discover_layers


def _spark() -> SparkSession:
    return SparkSession.builder.appName("terraloom").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="terraloom")
    p.add_argument("--registry", default="registry")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("datasets").add_subparsers(dest="action", required=True)
    x = a.add_parser("list")
    x.add_argument("--kind")
    x.add_argument("--limit", type=int, default=100)
    a.add_parser("show").add_argument("id")
    a = sub.add_parser("runs").add_subparsers(dest="action", required=True)
    x = a.add_parser("list")
    x.add_argument("--status")
    x.add_argument("--limit", type=int, default=100)
    a.add_parser("show").add_argument("id")
    sub.add_parser("checks").add_argument("id")
    sub.add_parser("lineage").add_argument("id")
    sub.add_parser("stats")
    sub.add_parser("route").add_argument("ref")
    sub.add_parser("discover").add_argument("where", help="a folder, file.duckdb, wms::url or wfs::url")
    x = sub.add_parser("run")
    x.add_argument("operator", help="an operator, or hydrology")
    x.add_argument("inputs", nargs="+")
    x.add_argument("-p", "--param", action="append", default=[], metavar="NAME=VALUE")
    x.add_argument("-s", "--service", action="append", default=[], metavar="NAME=VALUE", help="endpoint, bbox, width, height, crs, max_features or base, for inputs that services send")
    x.add_argument("-o", "--output", help="where to write the rows, as Parquet")
    return p


#: Options of services that aren't text.
SERVICE_OPTIONS = {"bbox": tuple[float, float, float, float], "width": int, "height": int, "max_features": int}


def discover(spark: SparkSession, where: str) -> DataFrame:
    """What there is at a place: files of a folder, tables of a DuckDB file, layers of a service."""
    if where.lower().startswith(("wms::", "wfs::")):
        return discover_layers(spark, Access(), where)
    return discover_duckdb(spark, where) if where.lower().endswith((".duckdb", ".db")) else discover_files(spark, where)


def _show(df: DataFrame, as_json: bool) -> int:
    rows = [r.asDict(recursive=True) for r in df.collect()]
    if as_json:
        print(json.dumps(rows, default=str))
    else:
        for r in rows:
            print("  ".join(f"{k}={v}" for k, v in r.items() if v is not None))
    return 0 if rows else 1


def summary(run: Run) -> dict:
    counts = {s.name.lower(): sum(c.state == s for c in run.checks) for s in State}
    return {"id": run.id, "operator": run.operator, "status": run.status, "error": run.error, "output": run.output.id if run.output else None, "checks": counts}


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "route":
        ref = SourceRef.infer(args.ref)
        found = default_router().select(ref)
        print(json.dumps({"ref": args.ref, "kind": ref.kind, "readers": found}) if args.json else f"{ref.kind}: {', '.join(found) or 'none'}")
        return 0 if found else 2
    spark = spark or _spark()
    if args.command == "discover":
        return _show(discover(spark, args.where), args.json)
    registry = Registry(spark, args.registry)
    if args.command == "datasets":
        df = registry.datasets(args.kind, args.limit) if args.action == "list" else registry.table("datasets").where(f"id = '{args.id}'")
        code = _show(df, args.json)
        return code if args.action == "show" else 0
    if args.command == "runs":
        df = registry.runs(args.status, args.limit) if args.action == "list" else registry.get_run(args.id)
        code = _show(df, args.json)
        return code if args.action == "show" else 0
    if args.command == "checks":
        return _show(registry.checks(args.id), args.json)
    if args.command == "lineage":
        return _show(registry.full_lineage(args.id).orderBy("depth", "parent"), args.json)
    if args.command == "stats":
        print(json.dumps(registry.stats()))
        return 0
    executor = Executor(registry)
    try:
        texts = dict(p.split("=", 1) for p in args.param)
        given = {k: coerce(v, SERVICE_OPTIONS.get(k, str)) for k, v in (x.split("=", 1) for x in args.service)}
        inputs = [materialize(spark, x, **given) for x in args.inputs]
        if args.operator == "hydrology":
            runs = hydrology_run(executor, inputs[0], **{k: float(v) for k, v in texts.items()})
        else:
            for d in inputs:
                registry.save_dataset(d)
            runs = [executor.submit(args.operator, inputs, build_params(get_operator(args.operator), texts))]
    except (KeyError, ValueError, LookupError, OSError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    last = runs[-1]
    print(json.dumps([summary(r) for r in runs]) if args.json else "\n".join(f"{r.operator}: {r.status}{f' ({r.error})' if r.error else ''}" for r in runs))
    if args.output and last.output is not None:
        last.output.df.write.mode("overwrite").parquet(args.output)
    return max(map(exit_code, runs))


if __name__ == "__main__":
    sys.exit(main())
