"""python -m recordloom export|import|expired STORE ...: a store's files from the command line."""

from __future__ import annotations

import argparse
import datetime as dt
import json

from pyspark.sql import functions as F

from recordloom.engine import RecordStore, at
from recordloom.session import local_session
from recordloom.sources import foreign
from recordloom.sources import store as files


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="recordloom")
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("export")
    e.add_argument("--active-only", action="store_true")
    i = sub.add_parser("import")
    i.add_argument("--dry-run", action="store_true")
    i.add_argument("--vendor", help="the file, folder or archive is a foreign list of this product")
    x = sub.add_parser("expired")
    x.add_argument("--scope")
    x.add_argument("--json", action="store_true")
    x.add_argument("--most", type=int, default=1000, help="lines shown; how many there are in all is said")
    for s in (e, i, x):
        s.add_argument("store")
    for s in (e, i):
        s.add_argument("path")
    args = p.parse_args(argv)
    spark, now = local_session(app="recordloom-cli"), dt.datetime.now(dt.UTC)
    records = RecordStore(spark, args.store)
    if args.command == "export":
        records.export(args.path, now, args.active_only)
        n = {r["status"]: r["count"] for r in records.records().groupBy("status").count().collect()}  # a row per status
        print(f"exported {n.get('active', 0)} active" + ("" if args.active_only else f" and {n.get('superseded', 0)} superseded") + f" records to {args.path}")
    elif args.command == "import":
        if args.vendor:
            loaded = foreign.load(spark, args.path)
            for r in foreign.sources_report(loaded, explicit=True).orderBy("name").limit(200).collect():
                print(f"{'read' if r['read'] else 'skipped'}: {r['name']} ({r['kind']})")
            found = foreign.records(foreign.entries(loaded, explicit=True), args.vendor, at(now))
        else:
            found = files.read_import(spark, args.path, at(now))
        report = records.import_records(found, now, args.dry_run)[1].head()
        print(f"{'would import' if args.dry_run else 'imported'} {report['imported']} of {report['total']}: " + ", ".join(f"{report[c]} {c}" for c in ("created", "superseded", "duplicate", "conflict", "possible_duplicate")) + f"; {report['skipped']} superseded records skipped")
    else:
        hidden = records.expired(now, args.scope)
        total, human = hidden.agg(F.count("*"), F.count_if(F.col("source").isin("user-explicit", "user-confirmed"))).head()
        lines = hidden.select("id", "type", "source", "text", "expires_at", "removable_at").limit(args.most)
        if args.json:
            print(json.dumps({"total": total, "human": human, "records": [json.loads(r) for r in lines.toJSON().collect()]}, ensure_ascii=False))
        else:
            for r in lines.collect():
                print(f"{r['id']}  {r['type'] or '-'}  {r['source']}  expired {r['expires_at']:%Y-%m-%d}, removable {r['removable_at']:%Y-%m-%d}  {r['text']}")
            print(f"{total} hidden records, {human} of them confirmed by a person" + (f"; {args.most} shown" if total > args.most else ""))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
