"""Command line: call-targets."""

from __future__ import annotations

import argparse
import logging
import os
import sys
import threading
from collections.abc import Iterator
from contextlib import contextmanager

from .params import CallParams, fraction


def _range(low: int, high: int | None = None):
    def parse(text: str) -> int:
        n = int(text)
        if n < low or (high is not None and n > high):
            raise argparse.ArgumentTypeError(f"{text} is not in the range from {low}" + (f" to {high}" if high is not None else ""))
        return n

    return parse


def _fraction(text: str) -> float:
    try:
        return fraction(text)
    except ValueError as e:
        raise argparse.ArgumentTypeError(str(e)) from e


def parser() -> argparse.ArgumentParser:
    general = argparse.ArgumentParser(add_help=False)
    general.add_argument("-v", "--verbose", action="count", default=argparse.SUPPRESS, help="stage times; twice: counts for each input")
    general.add_argument("-t", "--threads", type=_range(1), default=argparse.SUPPRESS, help="cores, where no cluster is configured")
    general.add_argument("--log-file", default=argparse.SUPPRESS, help="write messages to this file too")
    p = argparse.ArgumentParser(prog="sitewright", parents=[general])
    c = p.add_subparsers(dest="command", required=True).add_parser("call-targets", parents=[general])
    source = c.add_mutually_exclusive_group(required=True)
    source.add_argument("-i", "--input", action="append", help="BAM file or folder; may be repeated")
    source.add_argument("--bamlist", help="file with one BAM path a line")
    c.add_argument("-r", "--reference", required=True)
    c.add_argument("-T", "--targets", required=True)
    c.add_argument("-o", "--output", required=True)
    c.add_argument("--rg-map")
    c.add_argument("--index-type", choices=("csi", "tbi"), default="csi")
    c.add_argument("--min-mapq", type=_range(0, 60), default=20)
    c.add_argument("--min-baseq", type=_range(0, 60), default=20)
    c.add_argument("--min-alt-count", type=_range(0), default=1)
    c.add_argument("--min-alt-fraction", type=_fraction, default=0.0)
    c.add_argument("--max-depth", type=_range(0), default=100_000)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    with mirrored(getattr(args, "log_file", None)) as err:
        return _call(args, err)


@contextmanager
def mirrored(path: str | None) -> Iterator:
    """A stream on standard error. With a path, all that this process and those it starts write there, Spark's
    JVM included, goes to that file too, which is made anew."""
    if not path:
        yield sys.stderr
        return
    if folder := os.path.dirname(path):
        os.makedirs(folder, exist_ok=True)
    with open(path, "wb", buffering=0) as log, open(2, "w", closefd=False) as err:
        saved = os.dup(2)
        source, sink = os.pipe()
        os.dup2(sink, 2)
        os.close(sink)

        def pump() -> None:
            while data := os.read(source, 8192):
                os.write(saved, data)
                if not log.closed:
                    log.write(data)

        own = threading.Thread(target=pump, daemon=True)
        own.start()
        try:
            yield err
        finally:
            err.flush()
            os.dup2(saved, 2)
            # a JVM that was started within keeps its end open
            own.join(timeout=2)


def _call(args: argparse.Namespace, err) -> int:
    verbose = getattr(args, "verbose", 0)
    logging.basicConfig(level=logging.INFO if verbose else logging.WARNING, handlers=[logging.StreamHandler(err)], format="%(message)s", force=True)
    from pyspark.sql import SparkSession

    from .plans.run import run

    builder = SparkSession.builder.appName("sitewright").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if getattr(args, "threads", None):
        builder = builder.config("spark.master", f"local[{args.threads}]")
    params = CallParams(args.min_mapq, args.min_baseq, args.min_alt_count, args.min_alt_fraction, args.max_depth)
    try:
        run(builder.getOrCreate(), args.reference, args.targets, args.output, args.input, args.bamlist, args.rg_map, args.index_type, params, metrics=verbose > 1, verbose=verbose > 0)
    except Exception as e:  # noqa: BLE001
        logging.getLogger("sitewright").error("error: %s", e)
        return 1
    return 0
