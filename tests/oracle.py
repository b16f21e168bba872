"""Holds a query against its SQL as the driver does: by rows, columns sorted by name."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return str(v)


def duck_rows(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in cur.fetchall())


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(norm(r[n]) for n in names) for r in df.collect())
