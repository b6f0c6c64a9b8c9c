"""Runs a query and its SQL on the same tables and compares the rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings index_docs mail_docs scan_pages creator_values jobs job_errors index_embeddings index_profiles eval_items".split()


def connect(sf_dir):
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "tzinfo"):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, con, query, sql, sf_dir):
    """'' if equal, else what differs first."""
    df = query(spark, sf_dir)
    rel = con.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    a, b = rows_of(df.columns, df.collect()), rows_of(rel.columns, rel.fetchall())
    if a == b:
        return ""
    only = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
    return f"{len(a)} and {len(b)} rows; only in Spark {only[0]}, only in SQL {only[1]}"
