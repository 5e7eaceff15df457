"""Compares a Spark result with DuckDB SQL over the same Parquet tables."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str, **frames) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if name in frames:
            con.register(name, frames[name])
        else:
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(table) -> list[str]:
    frame = table.to_pandas(types_mapper=pd.ArrowDtype)
    frame = frame[sorted(frame.columns)]
    return [sorted(frame.columns)] + sorted(repr([None if x is pd.NA else x for x in r]) for r in frame.itertuples(index=False, name=None))


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    assert normal(df.toArrow()) == normal(con.sql(sql).to_arrow_table())
