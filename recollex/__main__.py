"""Commands over a store: python -m recollex <command> ..."""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="recollex")
    parser.add_argument("--store", default="recollex-store", help="folder of the store")
    commands = parser.add_subparsers(dest="command", required=True)
    add = commands.add_parser("import", help="documents of a file into the store")
    add.add_argument("source")
    add.add_argument("--format")
    out = commands.add_parser("export", help="documents of the store into a file")
    out.add_argument("target")
    out.add_argument("--format")
    find = commands.add_parser("search")
    find.add_argument("query")
    find.add_argument("--limit", type=int, default=10)
    commands.add_parser("stats")
    commands.add_parser("verify")
    line = commands.add_parser("timeline")
    line.add_argument("--limit", type=int, default=20)
    sql = commands.add_parser("sql")
    sql.add_argument("statement")
    options = parser.parse_args(argv)

    from pyspark.sql import functions as F

    from recollex.operators.store import Store
    from recollex.session import get_session
    from recollex.sources import files

    spark = get_session("recollex-cli")
    store = Store(spark, options.store)
    rows = lambda df: [r.asDict() for r in df.collect()]
    if options.command == "import":
        first = store.query_one("select coalesce(max(id), -1) + 1 as n from docs")["n"]
        docs = files.read_documents(spark, options.source, options.format).withColumn("id", F.lit(first) + F.monotonically_increasing_id())
        answer = {"added": store.put(docs).count()}
    elif options.command == "export":
        files.write_documents(store.docs(), options.target, options.format)
        answer = {"written": store.stats()["docs"]}
    elif options.command == "search":
        answer = store.search("lex", options.query, options.limit)
    elif options.command == "stats":
        answer = store.stats()
    elif options.command == "verify":
        answer = rows(store.verify())
    elif options.command == "timeline":
        answer = rows(store.timeline(options.limit))
    else:
        answer = rows(store.execute(options.statement).limit(1000))
    print(json.dumps(answer, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
