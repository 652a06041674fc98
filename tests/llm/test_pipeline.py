"""The pipeline on a small folder of tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H  # noqa: E402

import corpus_pipeline  # noqa: E402


@pytest.fixture()
def folder(spark, tmp_path):
    prose = lambda k: "the " + H.words(60, 50 + k) + " and the " + H.words(20, 90 + k)
    shared = H.words(70, 7)
    rows = [(k, prose(k)) for k in range(30)] + [(100, prose(3)), (101, prose(3) + " end"), (102, prose(70) + " " + shared), (103, prose(71) + " " + shared), (104, None), (105, "too short")]
    H.table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 0) for k in range(30)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and {r["quality"] for r in out.collect()} == {"q"}
        seen[name] = {r["doc_id"]: r["text"] for r in out.collect()}
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert not {104, 105} & set(seen["quality_rules"]) and set(range(30)) <= set(seen["toxicity"])
    assert not {100, 101} & set(seen["minhash_near_dedup"]) and {3, 102, 103} <= set(seen["minhash_near_dedup"])
    last = seen["suffix_array_dedup"]
    assert H.words(70, 7) in last[102] and H.words(70, 7)[5:] not in last[103]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()} == set(last)


def test_empty_tables(spark, tmp_path):
    H.table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
