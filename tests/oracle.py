"""Compare registered queries with their DuckDB SQL: ``python tests/oracle.py SF [NAME...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(df) -> list[tuple]:
    cols = sorted(df.columns)
    clean = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>") else (float(v) if hasattr(v, "__float__") and not isinstance(v, bool) and type(v).__name__ != "bool" else str(v))
    return sorted((tuple(clean(v) for v in r) for r in df[cols].itertuples(index=False)), key=repr)


def compare(spark, con, name: str, fn, sql: str, d: str) -> str:
    got, want = fn(spark, d).toPandas(), con.execute(sql).fetchdf()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} {sorted(want.columns)}"
    a, b = rows_of(got), rows_of(want)
    same = len(a) == len(b) and all(len(x) == len(y) and all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 1e-9 * max(1, abs(p))) for p, q in zip(x, y, strict=True)) for x, y in zip(a, b, strict=True))
    return "" if same else f"rows {len(a)} {len(b)} first differing {next(((x, y) for x, y in zip(a, b, strict=False) if x != y), None)}"


def main(sf: str, only: list[str]) -> int:
    import duckdb

    import __spark_entry__ as e
    from trackweave.session import local_session

    spark, con, d, bad = local_session(8), duckdb.connect(), f"/root/testdata/{sf}", 0
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    sqls = e.oracle_sql()
    for name, fn in e.queries().items():
        if (only and name not in only) or (not only and (name.startswith("op") or name == "pipeline")):
            continue
        began = time.time()
        try:
            said = compare(spark, con, name, fn, sqls[name], d) if name in sqls else f"no SQL, {fn(spark, d).count()} rows"
        except Exception as x:
            said = f"{type(x).__name__}: {str(x)[:600]}"
        bad += bool(said) and not said.startswith("no SQL")
        print(f"{name}: {said or 'equal'} ({time.time() - began:.1f} s)", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
