"""A registered query against its DuckDB SQL, rows in any order."""

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, np.ndarray):
        v = v.tolist()
    if isinstance(v, list):
        return [plain(x) for x in v]
    return None if v is None or v != v else v.item() if isinstance(v, np.generic) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, entry, name, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    con.execute("SET TimeZone = 'UTC'")
    found = con.execute(entry.oracle_sql()[name])
    want_columns = [d[0] for d in found.description]
    want = rows_of(want_columns, found.fetchall())
    df = entry.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert sorted(df.columns) == sorted(want_columns)
    assert len(got) == len(want)
    assert got == want
    return len(got)
