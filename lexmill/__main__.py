"""Command line: segments a file, a folder or standard input and writes JSON results, one document a line or indented."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from lexmill import config
from lexmill.plans.segment import segment, to_json
from lexmill.sources import io


def arguments(args: Sequence[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="lexmill")
    parser.add_argument("-i", "--input", help="UTF-8 file or folder; standard input if not given")
    parser.add_argument("-o", "--output", help="folder for one JSON text a line; standard output if not given")
    parser.add_argument("-c", "--config", help="settings, .json or .yaml")
    parser.add_argument("--language", choices=("auto", "zh", "en", "ja"))
    parser.add_argument("--mode", choices=("fast", "balanced", "precise"))
    parser.add_argument("--compact", action="store_true", help="no indentation on standard output")
    return parser.parse_args(args)


def main(args: Sequence[str] | None = None) -> int:
    given = arguments(args)
    over = {k: v for k, v in (("language", given.language), ("mode", given.mode)) if v}
    settings = config.merged(config.load(given.config), over)
    spark = SparkSession.builder.appName("lexmill").getOrCreate()
    if given.input:
        try:
            docs = io.read_files(spark, given.input)
            docs.schema  # noqa: B018  resolves the path
        except Exception as e:  # noqa: BLE001  whatever the store says about a missing path
            print(f"cannot read {given.input}: {str(e).splitlines()[0]}", file=sys.stderr)
            return 1
    else:
        text = sys.stdin.read()
        if not text.strip():
            print("no text on standard input", file=sys.stderr)
            return 1
        docs = io.from_texts(spark, [text])
    found = to_json(segment(docs, settings))
    if given.output:
        io.write_texts(found, given.output, "json")
    else:
        for row in found.toLocalIterator():
            print(row["json"] if given.compact else json.dumps(json.loads(row["json"]), ensure_ascii=False, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
