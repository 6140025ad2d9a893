"""The registered queries and the pipeline on the smallest tables."""

import duckdb
import pytest
from test_mix_shard import mix_brute
from test_simhash import components, fingerprint

import corpus_pipeline
from casework.llm import queries, simhash
from casework.sources.tables import table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, SF).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_each_stage_of_the_pipeline(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, {}
    rows = [tuple(r) for r in docs.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        before, rows = rows, [tuple(r) for r in docs.collect()]
        kept[name] = (before, rows)
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    before, after = kept["quality"]
    stay = {r[0] for r in after}
    judged = [(r[0] in stay) == bool(labels[r[0]]) for r in before if r[0] in labels]
    assert set(after) <= set(before) and sum(judged) >= 0.95 * len(judged)
    before, after = kept["near_dedup"]
    of = components([fingerprint(r[1]) for r in before], simhash.DISTANCE)
    least = {}
    for r in before:
        group = of[fingerprint(r[1])]
        least[group] = min(least.get(group, r), r)
    assert sorted(after) == sorted(least.values())
    before, after = kept["decontaminate"]
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    assert sorted(after) == sorted(r for r in before if not any(x in r[1] for x in items))
    before, after = kept["mix"]
    want = mix_brute(before, queries.MIX_WEIGHTS, queries.MIX_BUDGET, queries.MIX_EPOCHS)
    assert sorted((r[0], r[1]) for r in after) == sorted((i, t) for i, t, _ in want.elements())
    before, after = kept["shard"]
    total, at = sum(len(r[1].encode()) + 8 for r in before), 0
    for r in sorted(after, key=lambda r: (r[0], r[-2], r[-1])):
        size = len(r[1].encode()) + 8
        assert r[-2] == (2 * at + size) * queries.SHARDS // (2 * total)
        at += size
    assert sorted(r[:-2] for r in after) == sorted(before)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[-2:] == ["shard", "slot"] and out.count() > 0
