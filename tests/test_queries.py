"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from rolloom.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 3) + 0.0
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    rows = [r.asDict() for r in df.collect()]
    if name not in queries.ORACLES:
        assert df.columns
        return
    res = duck.execute(queries.ORACLES[name])
    names = [c[0] for c in res.description]
    want = [dict(zip(names, r, strict=True)) for r in res.fetchall()]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    key = lambda rs: sorted((tuple(plain(r[c]) for c in order) for r in rs), key=repr)
    assert key(rows) == key(want)


def test_all_keys_are_in(spark, tmp_path):
    rows = "SELECT id AS event_id, element_at(array('click', 'view', 'other', null), int(id % 4) + 1) AS event_type, timestamp'2024-01-05' AS ts, 1.0 AS value FROM range(12)"
    spark.sql(rows.replace("1.0", "1.0D")).write.parquet(f"{tmp_path}/events.parquet")
    assert {r.key: len(r.delays) for r in queries.bucket_delays(spark, str(tmp_path)).collect()} == {"click": 3, "view": 3, "other": 3, None: 3}
    assert {r.data_source: r.samples for r in queries.sample_staleness(spark, str(tmp_path)).collect()} == {"click": 3, "view": 3, "other": 3, None: 3}


def test_large_answers_match_their_sql(spark, tmp_path):
    keys = "SELECT id AS o_orderkey, id % 7 * 2500 + id % 3 AS o_custkey FROM range(600)"
    edge = [(n, k) for n in (124, 199, 249, 399, 499, 999, 1999) for k in range(19, 1940, 20)]  # sums of fractions on the bound of near ones
    spark.sql(keys).union(spark.createDataFrame([(100000 * (i + 1) + k, n) for i, (n, k) in enumerate(edge)], "o_orderkey long, o_custkey long")).write.parquet(f"{tmp_path}/orders.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    res = c.execute(queries.ORACLES["graded_responses"])
    names = [x[0] for x in res.description]
    assert sorted(queries.QUERIES["graded_responses"](spark, str(tmp_path)).select(*names).collect()) == sorted(res.fetchall())


def test_one_file_is_graded_by_many_tasks(spark):
    assert spark.read.parquet(f"{SF}/orders.parquet").rdd.getNumPartitions() == 1
    assert queries.QUERIES["graded_responses"](spark, SF).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
