"""python -m matchbook: lists the registered queries, or runs one over a data folder."""

from __future__ import annotations

import argparse

from matchbook.plans import QUERIES, SQL
from matchbook.session import local_session


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="matchbook", description="Runs a registered query over a folder of Parquet tables.")
    p.add_argument("query", nargs="?", help="its name; without one all names are listed")
    p.add_argument("folder", nargs="?", help="where <table>.parquet lie")
    p.add_argument("--out", help="a folder to write the result to; else its first rows are shown")
    p.add_argument("--format", default="parquet", choices=["parquet", "json", "csv"])
    p.add_argument("--sql", action="store_true", help="print the query's SQL, if it has one")
    p.add_argument("--explain", action="store_true", help="print the plan instead of running it")
    p.add_argument("--cores", default="*")
    a = p.parse_args(args)
    if a.query is None:
        for name in sorted(QUERIES):
            print(name, "-", ((QUERIES[name].__doc__ or "").strip().splitlines() or [""])[0])
        return 0
    if a.query not in QUERIES:
        p.error(f"no query {a.query}")
    if a.sql:
        print(SQL.get(a.query, "-- none").strip())
        return 0
    if a.folder is None:
        p.error("a folder is needed")
    df = QUERIES[a.query](local_session(a.cores), a.folder)
    if a.explain:
        df.explain("formatted")
    elif a.out:
        df.write.mode("overwrite").option("header", True).format(a.format).save(a.out)
    else:
        df.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
