"""An encoder of the user's own in the scorer: saved, loaded, in batches and streams."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array

from resonance.explain import words
from resonance.learning import bundle, encoder, models
from resonance.plans import training
from tests.test_learning import scoring_rows

LOADER = "resonance.learning.encoder:letter_counts"


def toy(size=6):
    return encoder.TextEncoder(loader=LOADER, options='{"size": 6}', size=size)


def test_vectors_are_the_encoders(spark):
    texts = ["abc", None, "", "ABC", "zzz é"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(2)
    stage = encoder.TextEncoder(inputCol="t", outputCol="v", loader=LOADER, options='{"size": 6}', size=6)
    got = {r["i"]: r["a"] for r in stage.transform(df).select("i", vector_to_array("v").alias("a")).collect()}
    want = encoder.letter_counts(6)([t or "" for t in texts])
    assert all(np.allclose(got[i], v) for i, v in enumerate(want))


def test_wrong_width_is_an_error(spark):
    df = spark.createDataFrame([("a",)], "t string")
    stage = encoder.TextEncoder(inputCol="t", outputCol="v", loader=LOADER, options='{"size": 6}', size=7)
    with pytest.raises(Exception, match="expected 7"):
        stage.transform(df).collect()


def test_scorer_with_an_encoder_is_saved_loaded_and_streamed(spark, tmp_path):
    df = scoring_rows(spark)
    fitted, _ = training.train_scorer(df, str(tmp_path / "b"), estimator=models.boosted(maxIter=3, maxDepth=3), encoder=toy())
    loaded, about = bundle.load_bundle(spark, str(tmp_path / "b"))
    assert about.first()["expected_dim"] == 5 + 7 + 6
    pick = lambda rows: sorted((r["post_id"], r["prediction"]) for r in rows.collect())
    want = pick(bundle.score(df, fitted))
    assert pick(bundle.score(df, loaded)) == want and len({p for _, p in want}) > 3
    assert any(isinstance(s, encoder.TextEncoder) for s in PipelineModel.load(str(tmp_path / "b/model")).stages)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = bundle.score(stream, loaded).writeStream.format("memory").queryName("encoded").trigger(availableNow=True).start()
    query.awaitTermination()
    assert pick(spark.table("encoded")) == want
    assert words.word_scores(df, loaded).count() == 40 * 3
