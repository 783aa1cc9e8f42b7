"""Command line: run a registered query or ask the documents a question."""

from __future__ import annotations

import argparse
import sys

from claimloom.errors import EngineError


def main(args: list[str] | None = None) -> int:
    """Exit code 0, or 1 with the error's text (an unknown profile, say)."""
    p = argparse.ArgumentParser(prog="claimloom")
    p.add_argument("folder", help="folder of the Parquet tables")
    p.add_argument("--query", help="name of a registered query")
    p.add_argument("--question", help="question to the documents")
    p.add_argument("--profile", action="append", default=[])
    p.add_argument("--web", action="store_true", help="ask for web results, too")
    p.add_argument("--format", choices=("text", "json", "markdown"), default="text")
    a = p.parse_args(args)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if a.query:
            from claimloom.plans.queries import QUERIES

            df = QUERIES[a.query](spark, a.folder)
        else:
            from claimloom.plans.engine import Engine
            from claimloom.sources.providers import StaticProfiles

            engine = Engine.standard(spark, a.folder, a.web)
            engine.profiles = StaticProfiles(spark, {"default": "{}"})
            request = spark.createDataFrame(
                [("cli", a.question or "", a.profile, a.web)],
                "result_id string, question string, profiles array<string>, use_web boolean",
            )
            run = engine.run(request)
            if a.format == "markdown":
                for row in run.rendered.toLocalIterator():
                    print(row.line)
                return 0
            df = run.relations["evidence"]
        # all rows, one partition of them at a time
        if a.format == "json":
            for row in df.toJSON().toLocalIterator():
                print(row)
        else:
            print("\t".join(df.columns))
            for row in df.toLocalIterator():
                print("\t".join("" if x is None else str(x) for x in row))
    except (EngineError, KeyError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
