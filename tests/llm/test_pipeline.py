import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_pipeline(spark):
    import corpus_pipeline
    from rolloom.llm import decontam, jaccard_join

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "t")
        rows = docs.collect()
        after = {r.doc_id: r.text for r in rows}
        assert set(after) <= set(before)
        if name != "sharding":
            assert docs.columns == columns
        if name == "n-gram Jaccard join":
            ids = sorted(before)
            root = jaccard_join.brute_force([before[i] for i in ids])
            assert set(after) == {ids[r] for r in root}
        if name == "benchmark decontamination":
            items = [(str(i), t) for i, t in duckdb.execute(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()]
            found = decontam.brute_force(list(before.values()), items)
            assert set(after) == {i for i, f in zip(before, found, strict=True) if not f["n_hit"]}
        sizes.append(len(rows))
    assert docs.columns == [*columns, "slot", "shard"] or set(docs.columns) == {*columns, "slot", "shard"}
    assert sizes[0] > 0.7 * 200 and sizes[-1] > 0


def test_queries_match_their_sql(spark):
    from rolloom.llm import entry

    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in entry.ORACLES.items():
        df = entry.QUERIES[name](spark, SF)
        res = c.execute(sql)
        names = [x[0] for x in res.description]
        assert sorted(names) == sorted(df.columns)
        order = sorted(names)
        want = [dict(zip(names, r, strict=True)) for r in res.fetchall()]
        key = lambda rows: sorted((tuple(round(r[k], 6) if isinstance(r[k], float) else r[k] for k in order) for r in rows), key=repr)
        assert key([r.asDict() for r in df.collect()]) == key(want), name


def test_full_queries_return_a_row_for_each_document(spark):
    from rolloom.llm import entry

    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1_toxicity", "op4_jaccard_join", "op6_quality", "op8_decontamination", "op10_secret_scan", "op12_token_counts"):
        assert entry.QUERIES[name](spark, SF).count() == n, name
