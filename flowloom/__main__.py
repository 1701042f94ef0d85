"""``python -m flowloom``: ``scan`` makes flow maps of a folder of fact tables, ``rules`` prints the default rules, ``example`` scans the built-in example."""

from __future__ import annotations

import argparse
import sys


def _scan(args: argparse.Namespace) -> int:
    from pyspark.sql import functions as F

    from flowloom import tables
    from flowloom.operators import entrypoints
    from flowloom.plans import scan
    from flowloom.session import local_session
    from flowloom.sources import facts, sinks
    from flowloom.sources.rules import parse_rules, read_settings, settings_tables

    spark = local_session()
    t = scan.read_tables(spark, args.facts)
    ruleset = None
    if args.rules:
        with open(args.rules, encoding="utf-8") as file:
            ruleset = parse_rules(file.read())
    if args.settings:
        settings, warnings = read_settings(args.settings)
        for line in warnings:
            print(f"warning: {line}", file=sys.stderr)
        t |= {name: table for name, table in settings_tables(spark, settings).items() if name in t}
    ratio = facts.generated_ratio(t["function"].where("in_module").select(F.col("file_class").alias("class"))).first()
    if ratio.warn:
        print(f"warning: {ratio.pct}% of the functions are generated", file=sys.stderr)
    entry = tables.keep(scan.entrypoints_of(t, args.module), "entrypoints")
    if args.entry:
        wanted = spark.createDataFrame([(args.entry,)], "wanted string")
        ids = entry.where(F.col("id") == args.entry)
        hit = entrypoints.resolve(wanted, entry.select("id"), args.module).first()
        if ids.isEmpty() and hit.status != "one":
            print(f"{args.entry}: " + ("no such entrypoint" if hit.status == "none" else "one of " + ", ".join(hit.candidates)), file=sys.stderr)
            return 2
        entry = ids if not ids.isEmpty() else entry.where(F.col("id") == hit.candidates[0])
    if entry.isEmpty():
        print("no entrypoints found", file=sys.stderr)
        return 1
    if not args.out:
        shown = entry.join(t["function"].select("fn_id", F.col("display_name").alias("func"), F.col("pos_text").alias("pos")), "fn_id", "left")
        for row in sinks.listing(shown).toLocalIterator():
            print(row.line)
        return 0
    docs = tables.keep(scan.scan(t, args.module, ruleset, entry), "documents")
    for name in sinks.write_files(docs, args.out):
        print(name)
    index = sinks.write_index(scan.index_of(docs, t["merge"], t["entity_name"], args.module), args.out)
    if args.html:
        with open(args.html, "w", encoding="utf-8") as file:
            file.write(sinks.html_page([(r.flow_id, r.doc) for r in docs.orderBy("flow_id").toLocalIterator()], index))
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="flowloom", description="Flow maps of programs.")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("rules", help="print the default rules")
    example = commands.add_parser("example", help="scan the built-in example")
    example.add_argument("folder")
    scan_ = commands.add_parser("scan", help="list the entrypoints of fact tables, or write their flow maps")
    scan_.add_argument("facts", help="folder of Parquet or JSON tables")
    scan_.add_argument("--module", required=True)
    scan_.add_argument("--entry", help="one entrypoint, by its id or the end of it")
    scan_.add_argument("--out", help="folder for the documents and index.json; without it entrypoints are listed")
    scan_.add_argument("--html", help="one page of all documents, with --out")
    scan_.add_argument("--rules", help="a rule file in place of the default rules")
    scan_.add_argument("--settings", help="a settings file: labels, entity names, merges")
    args = parser.parse_args(argv)
    if args.command == "rules":
        from flowloom.sources.rules import DEFAULT_RULES

        sys.stdout.write(DEFAULT_RULES)
        return 0
    if args.command == "scan":
        return _scan(args)
    from flowloom.plans import scan
    from flowloom.session import local_session
    from flowloom.sources import sinks

    documents, _ = scan.example(local_session())
    for name in sinks.write_files(documents, args.folder):
        print(name)
    return 0


if __name__ == "__main__":
    sys.exit(main())
