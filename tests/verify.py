"""Local restatement of the correctness gate: Spark query vs DuckDB SQL.

Compares row count, column names and an order-insensitive hash of the
values (columns sorted by name, floats rounded) for each query.
"""

from __future__ import annotations

import datetime as _dt
import decimal
import hashlib
import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


DIGITS = int(os.environ.get("VERIFY_DIGITS", "6"))  # < 0: compare floats exactly


def norm(v, digits: int = DIGITS):
    if v is None:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0 if digits < 0 else round(v, digits) + 0.0
    if isinstance(v, decimal.Decimal):
        return norm(float(v), digits)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), norm(x, digits)) for k, x in v.items()))
    if isinstance(v, (_dt.date, _dt.datetime)):
        return v.isoformat()
    if isinstance(v, bool):
        return int(v)
    return v


def fingerprint(columns: list[str], rows: list[tuple]) -> tuple[list[str], str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    keyed = sorted(repr(tuple(norm(r[i]) for i in order)) for r in rows)
    return cols, hashlib.md5("\n".join(keyed).encode()).hexdigest()


def compare(spark, sf_dir: str, names: list[str] | None = None, verbose: bool = True) -> dict:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    import __spark_entry__ as entry  # noqa: E402

    qs, sqls = entry.queries(), entry.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for name in names or list(qs):
        t0 = time.time()
        rec = {"oracle": name in sqls}
        try:
            sdf = qs[name](spark, sf_dir)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
            rec["rows"] = len(srows)
            if name in sqls:
                res = con.execute(sqls[name])
                dcols = [d[0] for d in res.description]
                drows = res.fetchall()
                rec["oracle_rows"] = len(drows)
                c1, h1 = fingerprint(scols, srows)
                c2, h2 = fingerprint(dcols, drows)
                rec["cols_match"] = c1 == c2
                rec["hash_match"] = h1 == h2
                rec["ok"] = c1 == c2 and h1 == h2 and len(srows) == len(drows)
                if not rec["cols_match"]:
                    rec["cols"] = (c1, c2)
            else:
                rec["ok"] = True
        except Exception as e:  # report and continue with the next query
            rec["ok"] = False
            rec["error"] = f"{type(e).__name__}: {str(e)[:400]}"
        rec["sec"] = round(time.time() - t0, 2)
        out[name] = rec
        if verbose:
            print(name, rec, flush=True)
    return out


if __name__ == "__main__":
    from newsweave.session import get_spark
    import tempfile
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = get_spark(master="local[8]", shuffle_partitions=8,
                      checkpoint_dir=tempfile.mkdtemp(prefix="nw-ckpt-", dir="/tmp"))
    spark.sparkContext.setLogLevel("ERROR")
    res = compare(spark, sf, sys.argv[1:] or None)
    bad = [k for k, v in res.items() if not v["ok"]]
    print("FAILED:", bad if bad else "none", f"({len(res) - len(bad)}/{len(res)} ok)")
