"""Compare every query with its SQL equivalent in DuckDB: python tests/verify_oracle.py [sf] [name...]"""

from __future__ import annotations

import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float) and value != value:
        return "nan"
    return value.item() if hasattr(value, "item") else value


def normal(columns: list[str], rows) -> list[tuple]:
    """Rows as plain values with columns in name order, sorted."""
    order = sorted(range(len(columns)), key=columns.__getitem__)
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v) for v in r))


def compare(ours: tuple, theirs: tuple) -> str | None:
    """What differs between two (columns, rows) results, including value types."""
    if sorted(ours[0]) != sorted(theirs[0]):
        return f"columns {sorted(ours[0])} != {sorted(theirs[0])}"
    if len(ours[1]) != len(theirs[1]):
        return f"rows {len(ours[1])} != {len(theirs[1])}"
    pairs = zip(normal(*ours), normal(*theirs))
    bad = [(x, y) for x, y in pairs if repr(x) != repr(y)]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None


def run_sql(con: duckdb.DuckDBPyConnection, text: str) -> tuple:
    result = con.execute(text)
    return [d[0] for d in result.description], result.fetchall()


def run_spark(df) -> tuple:
    return df.columns, df.collect()


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from measurelake.session import local_session

    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    only = sys.argv[2:]
    spark = local_session(8, spark__checkpoint__dir=tempfile.mkdtemp(prefix="verify-"))
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sql = oracle_sql()
    failed = 0
    for name, run in queries().items():
        if only and name not in only:
            continue
        try:
            start = time.time()
            ours = run_spark(run(spark, sf_dir))
            took = time.time() - start
            if name not in sql:
                print(f"----  {name}: {len(ours[1])} rows, no SQL ({took:.2f}s)")
                continue
            start = time.time()
            theirs = run_sql(con, sql[name])
            problem = compare(ours, theirs)
            print(f"{'FAIL' if problem else 'ok  '}  {name}: {len(ours[1])} rows "
                  f"({took:.2f}s / {time.time() - start:.2f}s) {problem or ''}", flush=True)
            failed += bool(problem)
        except Exception as error:  # noqa: BLE001 - report and go on
            failed += 1
            print(f"FAIL  {name}: {type(error).__name__} {str(error)[:600]}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
