import pytest
from pyspark.sql import functions as F

from sievekit import queries as Q
from sievekit.operators import select
from sievekit.plans import frames as P
from sievekit.sources import tables
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(Q.ORACLES))
def test_same_as_sql(spark, sf, con, name):
    compare(Q.QUERIES[name](spark, sf), con, Q.ORACLES[name])


def test_kmeans_covers_every_row(spark, sf):
    rows = Q.c3_kmeans(spark, sf).collect()
    assert sum(r.n for r in rows) == 500 and all(0 <= r.mean_dist <= 1 for r in rows)


#: Loops over whole clusterings without SQL; test_operators has each against a plain version, these are quick enough to run here.
@pytest.mark.parametrize("name", ["l17_select_by_class", "l25_facility_active", "l31_incremental"])
def test_rows_are_known_samples(spark, sf, name):
    ids = [r.sample_id for r in Q.QUERIES[name](spark, sf).collect()]
    assert ids and len(ids) == len(set(ids)) and all(0 <= i < 500 for i in ids)


def test_clusterings_cover_every_row(spark, sf):
    for rows in (Q.c8_kernel_kmeans(spark, sf).collect(), Q.c10_spectral(spark, sf).collect()):
        assert len(rows) == 500 and all(0 <= r.cluster_id < 10 for r in rows)


def test_splits_weights_and_logs_round_trip(spark, sf, tmp_path):
    v = P.vectors(spark, sf).select("sample_id", "label")
    tables.save_splits({"train": v, "meta": v.limit(3)}, f"{tmp_path}/s")
    back = tables.load_splits(spark, f"{tmp_path}/s")
    assert back["train"].count() == 500 and back["meta"].count() == 3 and back["test"] is None
    for epoch in (0, 2):
        tables.save_weights(v.select("sample_id", F.lit(float(epoch)).alias("w")), f"{tmp_path}/w", epoch)
    assert tables.load_weights(spark, f"{tmp_path}/w").agg(F.max("w")).first()[0] == 2.0 and tables.load_weights(spark, f"{tmp_path}/w", 0).count() == 500
    (tmp_path / "a.log").write_text("start\nfinal test performance is in epoch 3: 0.25, 0.91\n")
    row = tables.read_run_logs(spark, f"file://{tmp_path}/*.log").first()
    assert (row.epoch, row.loss, row.metric) == (3, 0.25, 0.91)


def test_budget(spark, sf):
    v = P.vectors(spark, sf)
    assert [select.remaining_budget(v, 9, t) for t in (None, 505, 10)] == [9, 5, 0]
