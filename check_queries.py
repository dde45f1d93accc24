"""Run catalog queries against their SQL twins: python check_queries.py [sf_dir] [name-part …]."""

from __future__ import annotations

import sys
import time

sys.path.insert(0, "tests")

from compare import connect, differences, run_query, run_sql  # noqa: E402

from pagemill.catalog import ORACLES, QUERIES  # noqa: E402
from pagemill.session import build_session  # noqa: E402


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [n for n in QUERIES if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            got = run_query(QUERIES[name](spark, sf_dir))
            took = time.time() - start
            if name in ORACLES:
                start = time.time()
                want = run_sql(con, ORACLES[name])
                verdict = differences(got, want) or "ok"
                verdict += f"   (sql {time.time() - start:.2f}s)"
            else:
                verdict = f"no sql; sample {got[1][:1]!r}"[:300]
            if got[1] == []:
                verdict += "   EMPTY"
        except Exception as err:  # report and go on with the next query
            took, verdict = time.time() - start, f"ERROR {type(err).__name__}: {str(err)[:1500]}"
            got = ((), ())
        if not verdict.startswith(("ok", "no sql")) or "EMPTY" in verdict:
            bad += 1
        print(f"{name:28s} {len(got[1]):7d} rows {took:6.2f}s  {verdict}", flush=True)
    print(f"{len(names)} queries, {bad} to look at")
    return bad


if __name__ == "__main__":
    sys.exit(main())
