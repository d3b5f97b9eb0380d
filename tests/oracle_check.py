"""Compare registered queries with their DuckDB SQL: ``python tests/oracle_check.py [sf_dir] [names...]``."""

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pressloom.plans.oracles import ORACLES  # noqa: E402
from pressloom.plans.registry import QUERIES  # noqa: E402


def connect(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value)
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


SAME_TYPE = {
    "bigint": {"BIGINT", "NUMBER"}, "int": {"INTEGER", "NUMBER"}, "double": {"DOUBLE", "NUMBER"},
    "string": {"VARCHAR", "STRING"}, "boolean": {"BOOLEAN"},
}


def type_differences(df, theirs):
    return {c: (t, theirs[c]) for c, t in df.dtypes if theirs[c] not in SAME_TYPE.get(t, {t})}


def compare(spark, con, name, folder):
    """None when the results agree, else a short description of the first difference."""
    df = QUERIES[name](spark, folder)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    answer = con.execute(ORACLES[name])
    answer_types = {c[0]: str(c[1]) for c in answer.description}
    theirs = rows_of([c[0] for c in answer.description], answer.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} and {theirs[0]}"
    types = type_differences(df, answer_types)
    if types:
        return f"types {types}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} rows and {len(theirs[1])} rows"
    different = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b]
    return f"{len(different)} of {len(ours[1])} rows differ, first: {str(different[0])[:600]}" if different else None


if __name__ == "__main__":
    from pressloom.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = local_session(), connect(folder)
    bad = 0
    for name in sys.argv[2:] or ORACLES:
        start = time.time()
        try:
            problem = compare(spark, con, name, folder)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:800]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{bad} of {len(sys.argv[2:] or ORACLES)} differ; no SQL: {sorted(set(QUERIES) - set(ORACLES))}")
