"""Run the whole analysis: ``python -m tallywise RAW_DIR OUT_DIR``."""

from __future__ import annotations

import argparse

from .params import DEFAULT_WEIGHTS
from .plans.engine import LIFESPANS, Engine
from .session import build_session
from .sources.catalog import default_files, fingerprint, read_csv_tables, read_parquet_tables
from .sources.schemas import TABLES
from .sources.staging import Stages


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tallywise", description=__doc__)
    parser.add_argument("raw_dir", help="folder with the eight input tables")
    parser.add_argument("out_dir", help="folder for result tables and dashboard CSVs")
    parser.add_argument("--format", choices=("csv", "parquet"), default="csv")
    parser.add_argument("--prefix", default="", help="file name before the table name")
    parser.add_argument("--suffix", default=".csv", help="file name after the table name")
    parser.add_argument(
        "--file", action="append", default=[], metavar="TABLE=NAME",
        help="file of one table, where prefix and suffix do not fit",
    )
    parser.add_argument("--weights", choices=("derived", "default"), default="derived")
    parser.add_argument("--lifespan", choices=LIFESPANS, default="auto")
    parser.add_argument("--forecast", action="store_true", help="also write the orders expected of every person")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    args = parse(argv)
    spark = build_session()
    if args.format == "csv":
        files = default_files(args.suffix, args.prefix)
        files.update(pair.split("=", 1) for pair in args.file)
        tables = read_csv_tables(spark, args.raw_dir, files)
    else:
        files = {t: f"{t}.parquet" for t in TABLES}
        tables = read_parquet_tables(spark, args.raw_dir)
    paths = [f"{args.raw_dir.rstrip('/')}/{name}" for name in files.values()]
    source = f"{args.format} {sorted(files.items())} {fingerprint(spark, paths)}"
    chosen = None if args.weights == "derived" else DEFAULT_WEIGHTS
    engine = Engine(tables, Stages(spark, source=source), chosen, args.lifespan)
    for name, path in engine.write(args.out_dir).items():
        print(f"{name}: {path}")
    if args.forecast:
        path = f"{args.out_dir.rstrip('/')}/forecast"
        engine.forecast().write.mode("overwrite").parquet(path)
        print(f"forecast: {path}")


if __name__ == "__main__":
    main()
