"""Stages of the pipeline on columns whose names are those that the stages use inside, with repeated and null ids, and on no rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

CLASHING = {"key": "K", "KEY_": 5, "own_id": "MINE", "at": 7, "AT_": None, "n": 3, "mark": "M", "millrace_mark": "N", "runs": "R", "digest": "D", "kept": "no", "component_id": 9, "c": 1, "node": 2, "lang_pred": "x", "score": 0.5}


@pytest.fixture(scope="module")
def docs(spark, small):
    base = spark.read.parquet(f"{small}/documents.parquet").limit(60).cache()
    odd = base.limit(3).withColumn("doc_id", F.lit(None).cast("long")).unionByName(base.limit(3))
    return {"plain": base, "odd": base.unionByName(odd)}


@pytest.mark.parametrize("kind", ["plain", "odd"])
def test_clashing_names_change_nothing(spark, small, docs, kind):
    import corpus_pipeline as pipeline

    rows = docs[kind]
    named = rows.select(*(F.lit(v).alias(k) for k, v in CLASHING.items() if k < "m"), *rows.columns, *(F.lit(v).alias(k) for k, v in CLASHING.items() if k >= "m"))
    shown = lambda df: sorted((tuple(r[c] for c in rows.columns) for r in df.collect()), key=repr)
    for name, stage in pipeline.STAGES[:-1]:
        with_names = stage(spark, named, small)
        assert with_names.columns == named.columns, name
        got = with_names.collect()
        assert all(tuple(r[k] for k in CLASHING) == tuple(CLASHING.values()) for r in got), name
        assert shown(with_names) == shown(stage(spark, rows, small)), name
        assert stage(spark, named.limit(0), small).collect() == [], name
    last = pipeline.STAGES[-1][1]
    assert last(spark, named, small).count() == last(spark, rows, small).count() > 0
