"""Compare registered queries with their SQL: ``python tests/check_sql.py [sf] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
DATA = "/root/testdata"


def canonical(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple('null' if v is None or v != v else repr(v) for v in row)
                  for row in pdf.astype(object).itertuples(index=False))


def plain(v):
    return v.item() if hasattr(v, "item") else v


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf{sf}/{t}.parquet'")
    return con


def difference(got, want) -> str | None:
    """None when equal, else a short account of the first difference."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    got, want = canonical(got.map(plain)), canonical(want.map(plain))
    if got == want:
        return None
    extra = [g for g in set(got) - set(want)][:2]
    lacking = [w for w in set(want) - set(got)][:2]
    return f"{len(got)} vs {len(want)} rows\n   spark {extra}\n   sql   {lacking}"[:1500]


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from resonance import get_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    wanted = sys.argv[2:]
    spark = get_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                        spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, failed = duck(sf), oracle_sql(), 0
    for name, fn in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, f"{DATA}/sf{sf}")
            got = df.toPandas()
            took = time.time() - start
            if name not in sql:
                print(f"rows {name}: {len(got)} rows {took:.1f}s {list(got.columns)}", flush=True)
                continue
            rel = con.sql(sql[name])
            diff = difference(got, rel.df())
            types = sorted(zip(rel.columns, map(str, rel.types)))
            bad = [t for t in types if "HUGEINT" in t[1] or "DECIMAL" in t[1]]
            ours = {f.name: f.dataType.simpleString() for f in df.schema}
            pairs = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string",
                     "BOOLEAN": "boolean"}
            bad += [(n, t, ours[n]) for n, t in types if n in ours and pairs.get(t) != ours[n]]
            state = "FAIL" if diff or bad else "ok  "
            failed += bool(diff or bad)
            print(f"{state} {name}: {len(got)} rows {took:.1f}s {diff or ''} {bad or ''}", flush=True)
        except Exception as e:  # noqa: BLE001 - report and go on
            failed += 1
            print(f"FAIL {name}: {type(e).__name__} {str(e)[:1200]}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
