"""What worker processes keep between tasks."""

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from fathomline.llm import benchmark, pieces, storage
from fathomline.llm.queries import PIECES


def test_other_operators_drop_a_codec():
    """A task of the codec's own module finds it again; one of another module frees its memory first."""
    def run(batches):
        yield from batches

    own = pieces.codec(PIECES)
    run.__module__ = pieces.__name__
    assert list(storage.releasing(run)(iter([1]))) == [1] and pieces.codec(PIECES) is own
    run.__module__ = "fathomline.llm.quality"
    assert list(storage.releasing(run)(iter([2]))) == [2] and not pieces._READY
    assert pieces.codec(PIECES) is not own


def test_one_worker_process_a_core(spark):
    """Texts are cut in a stage of their own, so that no task runs two functions of batches at once."""
    docs = spark.createDataFrame([(k, f"{k} " + "one two three four five six seven eight nine ten " + "x y z " * 20) for k in range(4)], "doc_id long, text string")
    items = spark.createDataFrame([("i", "one two three four five six seven eight nine ten")], "item_id string, text string")
    found = benchmark.decontaminate(docs, items)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(found.collect())[0]["text"].split()[:3] == ["0", "x", "y"]


def test_stages_hand_small_batches_to_workers(spark, folder):
    """Every stage of the pipeline bounds the bytes of a batch; a bound that the session sets itself stays."""
    key = storage.BATCH_BYTES[0]
    docs = spark.createDataFrame([(k, "one two three " * 20, "en", "web", 280) for k in range(3)], "doc_id long, text string, lang string, source string, n_chars long")
    long_texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.unset(key)
            stage(spark, docs, folder)
            found = [r["n"] for r in long_texts.mapInArrow(sizes, "n long").collect()]
            assert sum(found) >= 30_000_000 and max(found) < 8_000_000
        spark.conf.set(key, "20000000")
        corpus_pipeline.encoded(spark, docs, folder)
        assert spark.conf.get(key).startswith("20000000")
    finally:
        spark.conf.unset(key)
