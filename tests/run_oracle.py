"""Command line: python tests/run_oracle.py [sf_dir] [name prefix ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]

from oracle import compare, connect  # noqa: E402

import __spark_entry__ as entry_module  # noqa: E402
from repotide.session import build_session  # noqa: E402


def main(sf: str, prefixes: list[str]) -> int:
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf), 0
    oracles = entry_module.oracle_sql()
    for name, job in entry_module.queries().items():
        if prefixes and not name.startswith(tuple(prefixes)):
            continue
        start = time.time()
        try:
            df = job(spark, sf)
            if name in oracles:
                count, problems = compare(con, df, oracles[name])
            else:
                count, problems = len(df.collect()), []
        except Exception as error:  # report and go on
            count, problems = -1, [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(problems)
        print(f"{'BAD' if problems else 'ok '} {name} rows={count} {time.time() - start:.1f}s"
              f"{'' if name in oracles else ' (no oracle)'} {' | '.join(problems)[:900]}", flush=True)
    print("problems:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001", sys.argv[2:])))
