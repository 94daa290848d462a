"""Compare a query with its SQL twin in DuckDB, row by row, whatever the order."""

import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(d):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return c


def plain(v):
    if v is None:
        return "NULL"
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


def both(spark, query, sql, d):
    out = query(spark, d)
    names = sorted(out.columns)
    ours = sorted((str([plain(v) for v in row]) for row in out.select(*names).collect()))
    q = connect(d).execute(sql)
    found = [x[0] for x in q.description]
    assert sorted(found) == names
    order = [found.index(n) for n in names]
    theirs = sorted(str([plain(row[i]) for i in order]) for row in q.fetchall())
    return ours, theirs
