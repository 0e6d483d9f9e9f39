"""Rows of a query and of SQL, compared without order."""

import math
import os
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings cells eval_items gene_panel lang_samples negative_controls scenario_def simulated_parquet sphere spots transcripts".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(_plain(r[i]) for i in order) for r in data)


def connection():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def check(spark, con, query, sql):
    df = query(spark, DATA)
    want = con.sql(sql)
    names = list(want.columns)
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, want.limit(10**9).fetchall())
