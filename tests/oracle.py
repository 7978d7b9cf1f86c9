"""Comparison of a Spark result with DuckDB's for the same rows."""

import os

import duckdb
import pyarrow as pa

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if v != v else v + 0.0
    return v


def differences(got: pa.Table, want: pa.Table) -> list[str]:
    """Messages about columns, types, counts and values; none for equal tables in any order."""
    if sorted(got.column_names) != sorted(want.column_names):
        return [f"columns {sorted(got.column_names)} and {sorted(want.column_names)}"]
    cols = sorted(got.column_names)
    kind = lambda t: pa.string() if pa.types.is_large_string(t) else t
    out = [f"{c}: {got.schema.field(c).type} and {want.schema.field(c).type}" for c in cols if kind(got.schema.field(c).type) != kind(want.schema.field(c).type)]
    if got.num_rows != want.num_rows:
        return [*out, f"{got.num_rows} and {want.num_rows} rows"]
    text = lambda t: sorted(repr(tuple(_plain(v) for v in r)) for r in zip(*(t.column(c).to_pylist() for c in cols)))
    bad = [(x, y) for x, y in zip(text(got), text(want)) if x != y]
    return out + [f"{len(bad)} rows differ, such as {x}" for x in bad[:1]]
