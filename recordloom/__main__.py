"""Command line: files in, one JSON document or a folder of JSON lines out."""

from __future__ import annotations

import argparse
import os
import sys

from recordloom.operators.schema import profile_schema


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="recordloom", description="Turn person records of several sources into profiles.")
    parser.add_argument("-s", "--sources", nargs="+", default=[], help="CSV, JSON, PDF, DOCX and text files")
    parser.add_argument("-c", "--config", help="a projection, as a JSON file")
    parser.add_argument("-o", "--output", default="output/result.json", help="a .json file for one document, else a folder for JSON lines")
    parser.add_argument("--as-of", help="the month (YYYY-MM) until which jobs without an end last")
    parser.add_argument("--master", default=None, help="the Spark master; the running session's by default")
    parser.add_argument("--schema", action="store_true", help="print the shape of a profile and end")
    given = parser.parse_args(argv)
    if given.schema:
        print(profile_schema())
        return 0
    if not given.sources:
        parser.error("no sources")
    from recordloom.operators import projection
    from recordloom.plans.engine import Engine, Options, envelope, write_json
    from recordloom.runtime import session

    spark = session(given.master) if given.master else session()
    options = Options(as_of=given.as_of) if given.as_of else Options()
    result = Engine(spark, options).run(given.sources, projection.load_config(given.config) if given.config else None)
    if given.output.endswith(".json"):
        text = envelope(result)
        os.makedirs(os.path.dirname(given.output) or ".", exist_ok=True)
        with open(given.output, "w", encoding="utf-8") as out:
            out.write(text)
        print(text)
    else:
        write_json(result, given.output)
    print(f"{result.metadata['candidate_count']} profiles of {len(given.sources)} sources in {given.output}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
