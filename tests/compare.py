"""Side-by-side check of registered queries: the Spark result and the SQL result must hold the same rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(d: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    if hasattr(value, "as_integer_ratio") and not isinstance(value, (int, float)):
        return float(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(table, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark, con, query, d: str) -> str | None:
    """None if both sides agree, else what differs."""
    frame = query.plan(spark, d)
    spark_names, spark_rows = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if query.sql is None:
        return None if spark_rows else "no rows"
    result = con.execute(query.sql)
    sql_names, sql_rows = rows_of([c[0] for c in result.description], result.fetchall())
    if spark_names != sql_names:
        return f"columns {spark_names} / {sql_names}"
    if len(spark_rows) != len(sql_rows):
        return f"{len(spark_rows)} rows / {len(sql_rows)} rows; {spark_rows[:2]} / {sql_rows[:2]}"
    for mine, other in zip(spark_rows, sql_rows):
        if mine != other or [type(x) for x in mine] != [type(x) for x in other]:
            return f"{spark_names}: {str(mine)[:400]} / {str(other)[:400]}"
    return None if spark_rows else "no rows"


def main(argv: list[str]) -> int:
    from partloom import build_session
    from partloom.plans import REGISTRY

    d = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    wanted = argv[2:] or list(REGISTRY)
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(d)
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            problem = compare(spark, con, REGISTRY[name], d)
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:700]}"
        kind = "E" if REGISTRY[name].sql else "R"
        print(f"{'ok ' if problem is None else 'BAD'} {kind} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
        bad += problem is not None
    print(f"{len(wanted) - bad} of {len(wanted)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv))
