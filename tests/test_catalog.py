"""Every registered graph query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from shapeloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()
#: These learn or parse; tests/test_mining.py has their cases.
SLOW = {"reconstruct_equal"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLES) - SLOW))
def test_same_rows_as_sql(spark, db, name):
    want = db.sql(catalog.ORACLES[name]).df()
    columns = sorted(want.columns)
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == columns
    tidy = lambda df: df[columns].sort_values(columns, ignore_index=True)
    pd.testing.assert_frame_equal(tidy(got), tidy(want), check_dtype=False)


def test_entry_is_registered(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["key", "frequency", "gain"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_signal_graph_has_every_point(spark):
    """Each series of n values with its own delay tau gives a path of n - tau vertices, however long it is."""
    from shapeloom.operators import signals
    from shapeloom.plans import inputs

    series = signals.bandpass(inputs.series(spark, SF), 160.0, 0.0, 60.0)
    sizes = series.groupBy("series_id").count().join(signals.estimate_tau(series), "series_id").collect()
    want = {r["series_id"]: n for r in sizes if (n := r["count"] - r["tau"] - 1) > 0}
    got = {r["graph_id"]: r["count"] for r in catalog.QUERIES["signal_graph"](spark, SF).groupBy("graph_id").count().collect()}
    assert got == want and max(got.values()) >= 40


def test_tau_of_a_slow_series(spark, tmp_path):
    """The first lag that isn't positive may be 20 or more."""
    rows = spark.range(160).selectExpr("id AS event_id", "1 AS user_id", "id AS ts", "CAST(cos(id * pi() / 80) AS DOUBLE) AS value")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    assert catalog.QUERIES["autocorr_tau"](spark, str(tmp_path)).first()["tau"] > 20


def test_mining_grows_beyond_order_three(spark):
    groups = catalog.QUERIES["detect_groups"](spark, SF).agg({"ord": "max"}).first()[0]
    histogram = catalog.QUERIES["order_histogram"](spark, SF).agg({"ord": "max"}).first()[0]
    assert groups == 5 and histogram == 4


@pytest.mark.parametrize("repeats", [True, False])
def test_shapes_on_borders_of_cells(spark, db, tmp_path, repeats):
    """Values in steps of 20 put many points on borders, and repeated ones make edges at a single place."""
    step = "CREATE OR REPLACE VIEW e AS SELECT * REPLACE (floor(value / 20) * 20 + 0.1 * user_id + 0.37 AS value) FROM '/root/testdata/sf0.01/events.parquet'"
    last = "lag(value, 1, -1e9) OVER (PARTITION BY user_id ORDER BY ts, event_id)"
    con = db.cursor()
    con.execute(step)
    con.execute(f"COPY (SELECT * FROM e {'' if repeats else f'QUALIFY value <> {last}'}) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE SCHEMA odd_{repeats}; CREATE VIEW odd_{repeats}.events AS SELECT * FROM '{tmp_path}/events.parquet'; USE odd_{repeats}")
    want = sorted(con.sql(catalog.ORACLES["isogroup_frequency_order3"]).fetchall())
    got = sorted(map(tuple, catalog.QUERIES["isogroup_frequency_order3"](spark, str(tmp_path)).collect()))
    assert got == want and len(want) > 50
