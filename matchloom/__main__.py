"""python -m matchloom --mock | --image PATH ... --ledger PATH [--output PATH] [--log-level LEVEL]"""

from __future__ import annotations

import argparse
import importlib
import importlib.util
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .plans import pipeline
from .sources import connectors
from .sources.datasources import indented


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="matchloom", description="Match invoices to ledger rows one to one.")
    mode = p.add_mutually_exclusive_group(required=True)
    mode.add_argument("--image", nargs="+", metavar="PATH", help="invoice images to extract and match")
    mode.add_argument("--mock", action="store_true", help="run on the built-in demo rows")
    p.add_argument("--ledger", metavar="PATH", help="the ledger, a JSON array (goes with --image)")
    p.add_argument("--output", metavar="PATH", help="where to put the results as one JSON array")
    p.add_argument("--log-level", choices=["DEBUG", "INFO", "WARNING", "ERROR"], default="INFO")
    p.add_argument("--ocr", metavar="MODULE:FUNCTION", help="makes the OCR engine; paddleocr where it is installed")
    return p


def show(results, output: str | None = None) -> None:
    print("\n" + "=" * 60 + "\n INVOICE - LEDGER MATCHING RESULTS\n" + "=" * 60)
    for line in connectors.console_table(results):
        print(line)
    print("\nDetailed JSON output:")
    k = 0
    for k, r in enumerate(connectors.summary_json(results.orderBy("batch_id", "invoice_idx")).toLocalIterator(), 1):
        print(("[" if k == 1 else ",") + f"\n  {indented(r['value'])}", end="")
    print("\n]" if k else "[]")
    if output:
        connectors.write_results(results.orderBy("batch_id", "invoice_idx"), output)
        connectors.log.info("full results written to %s", output)


def main(argv: list[str] | None = None) -> int:
    p = build_parser()
    args = p.parse_args(argv)
    log = connectors.get_logger("matchloom", args.log_level)
    if args.image and not args.ledger:
        p.error("--ledger is required with --image")
    if args.image and not Path(args.ledger).exists():
        log.error("ledger not found: %s", args.ledger)
        return 1
    if args.image and not args.ocr and importlib.util.find_spec("paddleocr") is None:
        log.error("no OCR engine: install paddleocr, or name another with --ocr MODULE:FUNCTION")
        return 1
    spark = SparkSession.builder.appName("matchloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.mock:
        results = pipeline.match_mock(spark)
    else:
        module, _, name = (args.ocr or "matchloom.sources.connectors:default_ocr").partition(":")
        there = [x for x in args.image if Path(x).exists()]
        for x in set(args.image) - set(there):
            log.error("image not found: %s", x)
        if not there:
            return 1
        results, failed = pipeline.match_images(spark, there, connectors.read_ledger(spark, args.ledger), getattr(importlib.import_module(module), name))
        for r in failed.toLocalIterator():
            log.error("%s: %s", r["doc_id"], r["_error"])
        results = pipeline.finished(results)
        if results.isEmpty():
            log.error("no invoice could be extracted")
            return 1
        show(results, args.output)
        return 0
    show(pipeline.finished(results), args.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
