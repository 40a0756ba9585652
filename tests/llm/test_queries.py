import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import SF, connection, rows_of_spark, rows_of_sql  # noqa: E402

import corpus_pipeline  # noqa: E402
from foliant.llm import queries  # noqa: E402
from foliant.llm.packing import best_fit  # noqa: E402

from test_similar import brute_roots, brute_sets  # noqa: E402


def normal(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    assert rows_of_spark(queries.QUERIES[name](spark, SF)) == rows_of_sql(connection(), queries.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_covers_all_documents(spark, name):
    ids = {r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert {r["doc_id"] for r in queries.QUERIES[name](spark, SF).select("doc_id").collect()} == ids


def test_pipeline_stages_by_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, at = docs.columns, docs
    seen = [{r["doc_id"]: r["text"] for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, SF).write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert at.columns == columns
            rows = at.collect()
            seen.append({r["doc_id"]: r["text"] for r in rows})
            assert len(rows) == len(seen[-1]) and set(seen[-1].items()) <= set(seen[-2].items())
    before, after = seen[2], seen[3]
    assert set(after) == {max(i for i, t in before.items() if normal(t) == n) for n in {normal(t) for t in before.values()}}
    ids = sorted(after)
    roots = brute_roots(brute_sets([(i, after[i]) for i in ids]))
    assert set(seen[4]) == {ids[r] for r in roots}
    packed = at.collect()
    assert {r["doc_id"] for r in packed} == set(seen[4])
    assert len({r["sequence_id"] for r in packed}) <= len(best_fit(sorted((r["length"] for r in packed), reverse=True), 2048)) + 1
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
