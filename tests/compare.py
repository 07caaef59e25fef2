"""Run a query in Spark and its SQL in DuckDB and compare columns, types and rows."""

import datetime
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

FAMILY = {
    "int": "int32",
    "bigint": "int64",
    "double": "double",
    "string": "text",
    "boolean": "bool",
    "timestamp": "time",
    "INTEGER": "int32",
    "BIGINT": "int64",
    "DOUBLE": "double",
    "VARCHAR": "text",
    "BOOLEAN": "bool",
    "TIMESTAMP": "time",
}


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if value is None:
        return (0, "")
    if isinstance(value, float):
        return (1, "nan" if math.isnan(value) else f"{value:.6f}")
    if isinstance(value, datetime.datetime):
        return (1, value.isoformat())
    return (1, str(value))


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def difference(df, con, sql):
    """None if both agree, else a short description."""
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    types = {d[0]: FAMILY.get(str(d[1]), str(d[1])) for d in result.description}
    wanted = result.fetchall()
    spark_types = {name: FAMILY.get(kind, kind) for name, kind in df.dtypes}
    if spark_types != types:
        return f"types differ: spark {spark_types}, sql {types}"
    got = df.collect()
    if len(got) != len(wanted):
        return f"{len(got)} rows in spark, {len(wanted)} in sql"
    left, right = normal(df.columns, got), normal(columns, wanted)
    for a, b in zip(left, right):
        if a != b:
            return f"first difference (columns {sorted(columns)}):\n spark {a}\n sql   {b}"
    return None
