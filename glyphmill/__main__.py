"""Command line: python -m glyphmill ROOT tree|outline|find|search|word|hot|deps|read|status|snapshot [ARGUMENT]"""

from __future__ import annotations

import argparse
import shutil
import sys

#: What the one argument of a command is called among the tool's arguments.
ARGUMENT = {"outline": "path", "find": "query", "search": "query", "word": "word", "deps": "path", "read": "path", "symbol": "name"}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="glyphmill", description=__doc__)
    parser.add_argument("root")
    parser.add_argument("command", choices=["tree", "outline", "find", "search", "symbol", "word", "hot", "deps", "read", "status", "snapshot", "projects", "nuke"])
    parser.add_argument("argument", nargs="?")
    parser.add_argument("--store", default=".glyphmill")
    parser.add_argument("--regex", action="store_true")
    parser.add_argument("--limit", type=int, default=50)
    a = parser.parse_args(argv)
    if a.command in ARGUMENT and not a.argument:
        parser.error(f"{a.command} needs an argument")

    from pyspark.sql import SparkSession

    from glyphmill.plans import dispatch
    from glyphmill.sources import projects

    if a.command == "projects":
        for p in projects.list_projects(a.store):
            print(p["path"], "with snapshot" if p["snapshot"] else "without snapshot")
        return 0
    if a.command == "nuke":
        shutil.rmtree(projects.data_folder(a.store, a.root), ignore_errors=True)
        return 0
    spark = SparkSession.builder.appName("glyphmill").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    if a.command == "snapshot":
        print(projects.build_index(spark, a.root, a.store))
        return 0
    engine = dispatch.Engine.of(projects.Projects(spark, a.store).load(a.root))
    args = {ARGUMENT[a.command]: a.argument} if a.command in ARGUMENT else {}
    for row in dispatch.call(engine, a.command, args | {"regex": a.regex, "max_results": a.limit, "limit": a.limit}).toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))
    return 0


if __name__ == "__main__":
    sys.exit(main())
