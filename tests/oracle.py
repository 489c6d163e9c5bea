"""Side-by-side comparison of a Spark query and its checking SQL."""

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float) and not math.isnan(v):
        return round(v, 9)
    if hasattr(v, "as_integer_ratio") and not isinstance(v, int):
        return round(float(v), 9)
    return v


def compare(df, con, sql):
    """Empty string if equal, else a short description of the difference."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    order = sorted(names)
    pick = [names.index(n) for n in order]
    want = Counter(tuple(norm(r[i]) for i in pick) for r in cur.fetchall())
    got = Counter(tuple(norm(r[n]) for n in order) for r in df.collect())
    if want == got:
        return ""
    extra, missing = got - want, want - got
    return (f"rows {sum(got.values())} != {sum(want.values())}; {order}; "
            f"only spark {list(extra.items())[:3]}; only sql {list(missing.items())[:3]}")
