"""``minute_document`` against its SQL on one DuckDB thread, where a last bit decides and where values are missing."""

import datetime

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from compare import rows_of

import __spark_entry__ as entry


def written(folder, files):
    """events.parquet in ``folder``: a list of (gun, value, k) for each file, in the order of event_id."""
    path = folder / "events.parquet"
    path.mkdir()
    at, n = datetime.datetime(2024, 1, 1), 0
    for i, rows in enumerate(files):
        ids = np.arange(n, n + len(rows))
        n += len(rows)
        cols = {
            "event_id": ids,
            "ts": pa.array([at + datetime.timedelta(seconds=int(x) % 80_000) for x in ids], pa.timestamp("us")),
            "user_id": pa.array([r[0] for r in rows], pa.int64()),
            "event_type": ["view"] * len(rows),
            "value": pa.array([r[1] for r in rows], pa.float64()),
            "props": [f'{{"k": {r[2]}}}' if r[2] is not None else "{}" for r in rows],
        }
        pq.write_table(pa.table(cols), path / f"{i}.parquet")


def both(spark, folder):
    con = duckdb.connect(config={"threads": 1})
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    got = con.sql(entry.oracle_sql()["minute_document"])
    df = entry.queries()["minute_document"](spark, str(folder))
    return rows_of(df.columns, df.collect()), rows_of(got.columns, got.fetchall())


def z_of(total, n):
    return abs((total / n - 50) / 30)


def test_a_window_is_added_up_in_order_whatever_files_it_lies_in(spark, tmp_path):
    rng = np.random.default_rng(1)
    files = [[], []]
    for gun in range(4000):
        # values whose mean lies as many deviations from 50 as that of k, so that only last bits differ
        k = rng.integers(20, 81, 4)
        cents = rng.multinomial(20_000 + 120 * (k.sum() - 200), [0.25] * 4)
        v = cents / 100
        row, half = ((v[0] + v[1]) + v[2]) + v[3], (v[0] + v[1]) + (v[2] + v[3])
        limit = abs((k.mean() - 50) / 25)
        if (z_of(row, 4) >= limit) != (z_of(half, 4) >= limit):
            for i in range(4):
                files[i // 2].append((gun, float(v[i]), int(k[i])))
    assert len(files[0]) > 100
    written(tmp_path, files)
    mine, sql = both(spark, tmp_path)
    assert mine == sql


def test_missing_values_stand_as_in_sql(spark, tmp_path):
    nan = float("nan")
    written(tmp_path, [[(1, None, None), (2, 70.0, None), (3, None, 90), (4, nan, 99), (5, 70.0, None), (5, 20.0, 51), (6, None, 3), (6, 44.0, 8)]])
    mine, sql = both(spark, tmp_path)
    assert mine == sql
