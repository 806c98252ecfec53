"""Compare registered queries with their SQL in DuckDB: ``python -m strideframe.check <sf_dir> [name ...]``."""

import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def rows_of(pdf):
    """Sorted rows with columns in name order, values in comparable form."""
    import numpy as np
    import pandas as pd

    def plain(v):
        if isinstance(v, (list, tuple, np.ndarray)):
            return tuple(plain(x) for x in v)
        if isinstance(v, dict):
            return tuple(plain(x) for x in v.values())
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, (bool, np.bool_)):
            return bool(v)
        if isinstance(v, (int, np.integer)):
            return int(v)
        if isinstance(v, (float, np.floating)):
            f = float(v)
            return int(f) if f == int(f) and abs(f) < 2**53 else f
        return str(v)

    columns = sorted(pdf.columns)
    data = [tuple(plain(v) for v in row) for row in pdf[columns].itertuples(index=False, name=None)]
    return columns, sorted(data, key=repr)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "timestamp": "TIMESTAMP"}


def type_differences(mine, relation) -> list[str]:
    """Columns of plain types whose type differs between the two engines."""
    theirs = dict(zip(relation.columns, (str(t) for t in relation.types)))
    return [
        f"{f.name}: {f.dataType.simpleString()} vs {theirs[f.name]}" for f in mine.schema
        if f.dataType.simpleString() in KINDS and f.name in theirs and theirs[f.name] != KINDS[f.dataType.simpleString()]
    ]


def compare(spark, sf: str, name: str, connection=None) -> tuple[bool, str]:
    import duckdb

    from strideframe.plans import catalogue

    con = connection or duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    t0 = time.time()
    frame = catalogue.queries()[name](spark, sf)
    mine = frame.toPandas()
    t1 = time.time()
    if name not in catalogue.oracle_sql():
        return True, f"rows={len(mine)} (no SQL) spark={t1 - t0:.1f}s"
    relation = con.sql(catalogue.oracle_sql()[name])
    theirs = relation.df()
    t2 = time.time()
    (c1, r1), (c2, r2) = rows_of(mine), rows_of(theirs)
    note = f"rows={len(r1)}/{len(r2)} spark={t1 - t0:.1f}s duckdb={t2 - t1:.1f}s"
    if c1 != c2:
        return False, f"{note} columns {sorted(set(c1) ^ set(c2))}"
    if r1 == r2:
        off = type_differences(frame, relation)
        return True, note + (f" TYPES {off}" if off else "")
    bad = [(a, b) for a, b in zip(r1, r2) if a != b]
    first = ""
    if bad:
        first = "; ".join(f"{c}: {x!r} vs {y!r}" for c, x, y in zip(c1, *bad[0]) if x != y)[:400]
    return False, f"{note} differing={len(bad)} first: {first}"


def main(sf: str, names: list[str]) -> int:
    from strideframe.plans import catalogue
    from strideframe.session import local_session

    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    failed = []
    for name in names or list(catalogue.queries()):
        try:
            ok, note = compare(spark, sf, name)
        except Exception as e:  # report and go on with the other queries
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
