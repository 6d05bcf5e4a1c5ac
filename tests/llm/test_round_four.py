"""What the pipeline's stages hold beside the heap: Python workers and what they keep."""
import sys
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from swipeflow.llm import pieces as P
from swipeflow.llm import simhash as S
from swipeflow.llm.common import prefix_sum


def held(run, batch):
    """Most bytes of Python objects while ``run`` answers a batch whose answers are not kept."""
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in run(iter([batch])))
        return rows, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("what", ["ids", "fingerprints"])
def test_a_batch_of_texts_is_held_once(what, monkeypatch):
    monkeypatch.setattr(P, "ANSWER_CHARS", 50_000)
    texts = [f"text {i} " + "the same words again " * 100 for i in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["c0", "c1"])
    run = P._ids(P._model(None), 1, 2) if what == "ids" else S._fingerprints(3)
    assert sum(b.num_rows for b in run(iter([batch.slice(0, 1)]))) == 1    # the tables of the pieces are made once
    rows, most = held(run, batch)
    assert rows == len(texts) and most < sum(map(len, texts)) / 2


def test_codec_gives_its_memory_back():
    model = P._model(None)
    batch = pa.RecordBatch.from_arrays([pa.array(["one two three", None, ""])], names=["c0"])
    out = pa.Table.from_batches(P._ids(model, 0, 1)(iter([batch]))).to_pylist()
    assert [r["c0"] for r in out] == ["one two three", None, ""] and [r["decoded"] for r in out] == ["one two three", "", ""]
    codec = sys.modules["_llm_per_process"].__dict__["pieces", hash(model), "rows"]
    assert not (codec or codec.old or codec.pairs) and codec.parts


def test_texts_travel_once(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    plan = P.encode(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "coalesce" not in plan
    kept = P.encode(df.withColumn("text", F.lit(7)).withColumn("text", F.col("text").cast("string")))
    assert [(r.text, r.decoded) for r in kept.collect()] == [("7", "7")] * 2


def test_prefix_sum_needs_no_python_workers(spark):
    df = spark.range(50).select("id", (F.col("id") % 3).alias("v"))
    out = prefix_sum(df, ["id"], "v", "s")
    assert "ExistingRDD" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.s for r in out.collect()} == {i: sum(j % 3 for j in range(i)) for i in range(50)}
    assert prefix_sum(df.where("id < 0"), ["id"], "v", "s").collect() == []
