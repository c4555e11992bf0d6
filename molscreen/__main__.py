"""Command line: ``python -m molscreen schema | predict | import``."""

from __future__ import annotations

import argparse
import sys

from molscreen.schemas import CHECKPOINT_ROWS


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="molscreen")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("schema", help="print the atom-feature layout as JSON")
    one = commands.add_parser("predict", help="score structures given on the command line")
    one.add_argument("smiles", nargs="+")
    many = commands.add_parser("import", help="score a library CSV")
    many.add_argument("input")
    many.add_argument("-o", "--out", required=True)
    many.add_argument("--smiles-column", default="smiles")
    many.add_argument("--skip-invalid", action="store_true")
    many.add_argument("--progress-every", type=int, default=CHECKPOINT_ROWS)
    for p in (one, many):
        p.add_argument("--references", required=True, help="Parquet with ref_id and words")
    args = parser.parse_args(argv)

    if args.command == "schema":
        from molscreen.functions.features import schema_json

        print(schema_json())
        return

    from pyspark.sql import SparkSession

    from molscreen.plans import screen
    from molscreen.session import SETTINGS, ship

    builder = SparkSession.builder.appName("molscreen")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = ship(builder.getOrCreate())
    refs = spark.read.parquet(args.references)
    if args.command == "predict":
        rows = spark.createDataFrame(list(enumerate(args.smiles)), "row_index long, smiles string")
        screen.screen(rows, refs).orderBy("row_index").show(len(args.smiles), truncate=False, vertical=True)
    else:
        tell = lambda done, failed: print(f"{done} rows, {failed} failed", file=sys.stderr)
        screen.import_library(spark, args.input, args.out, refs, args.smiles_column, args.skip_invalid, args.progress_every, tell).show()


if __name__ == "__main__":
    main()
