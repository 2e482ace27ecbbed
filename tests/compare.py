"""Run registered queries against their SQL and report row and value mismatches.

    python tests/compare.py sf0.01 [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(table: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples of text, columns in name order."""
    table = table[sorted(table.columns)]

    def text(v) -> str:
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "NULL"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return repr(float(v)) if not isinstance(v, (bool,)) else str(v)
        return str(v)[:10] if hasattr(v, "isoformat") else str(v)

    return sorted(tuple(text(v) for v in row) for row in table.itertuples(index=False, name=None))


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """What differs first, or None."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    a, b = normal(got), normal(want)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(wrong)} of {len(a)} rows differ, first {wrong[0]}" if wrong else None


def main() -> None:
    import __spark_entry__ as contract
    from shelfwise.session import local_session

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    spark = local_session()
    con = connect(sf_dir)
    sql = contract.oracle_sql()
    wanted = sys.argv[2:] or list(contract.queries())
    bad = []
    for name in wanted:
        started = time.time()
        try:
            got = contract.queries()[name](spark, sf_dir).toPandas()
            took = time.time() - started
            problem = difference(got, con.execute(sql[name]).df()) if name in sql else None
            kind = "" if name in sql else "(no SQL)"
        except Exception as e:
            got, took, problem, kind = [], time.time() - started, repr(e)[:700], ""
        if problem:
            bad.append(name)
        print(f"{'BAD' if problem else 'ok '} {name:28s}{took:7.2f}s {len(got):7d} {kind} {problem or ''}", flush=True)
    print(f"{len(wanted) - len(bad)} of {len(wanted)} agree; bad: {bad}")


if __name__ == "__main__":
    main()
