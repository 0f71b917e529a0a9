"""Commands over the plans: python -m tidemark.cli query NAME DIR, ingest, case, show, queries."""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidemark", description="Event forensics over news and market tables")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("queries", help="names of all registered queries")
    q = sub.add_parser("query", help="run a registered query over a folder of tables")
    q.add_argument("name")
    q.add_argument("folder")
    q.add_argument("--out", help="write Parquet there; without it, the first rows are shown")
    g = sub.add_parser("ingest", help="parse zipped observation batches into day tables")
    g.add_argument("batches")
    g.add_argument("out")
    g.add_argument("--origin", default="2024-12-16")
    c = sub.add_parser("case", help="build a day's case from daily prices")
    c.add_argument("prices")
    c.add_argument("day")
    c.add_argument("--market", default="SPY")
    c.add_argument("--fund", action="append", default=[])
    c.add_argument("--out")
    s = sub.add_parser("show", help="a case file as text")
    s.add_argument("file")
    a = p.parse_args(argv)

    from tidemark.sources import stores

    if a.command == "show":
        with open(a.file, encoding="utf-8") as f:
            print(stores.dossier(json.load(f)))
        return 0
    from tidemark.plans import case, ingest
    from tidemark.plans.queries import QUERIES
    from tidemark.session import local_session
    from tidemark.sources import batches

    if a.command == "queries":
        print("\n".join(sorted(QUERIES)))
        return 0
    spark = local_session("*")
    if a.command == "query":
        df = QUERIES[a.name](spark, a.folder)
        df.write.mode("overwrite").parquet(a.out) if a.out else df.show()
    elif a.command == "ingest":
        lines = batches.read_lines(spark, a.batches, "*.gkg.csv.zip")
        obs, links = ingest.observations(batches.gkg(lines), a.origin)
        ingest.flush(obs, a.out)
        links.write.mode("overwrite").parquet(f"{a.out}/dup_links")
        batches.quarantine(lines, "gkg").write.mode("overwrite").parquet(f"{a.out}/quarantine")
    else:
        text = json.dumps(case.build_case(spark.read.parquet(a.prices), a.day, a.market, set(a.fund)), indent=1)
        if a.out:
            with open(a.out, "w", encoding="utf-8") as f:
                f.write(text)
        else:
            print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
