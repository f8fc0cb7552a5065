"""Scores of trained models are computed once, whatever reads them."""

from pyspark.ml import PipelineModel

from framewise.operators import bounce, models
from framewise.sources.samples import Samples
from tests.test_shared_steps import SF, plan


def test_scores_of_a_model_are_computed_once(spark):
    t = Samples(spark, SF)
    features = bounce.bounce_features(t.track)
    model = models.fit_bounce_model(features, t.bounce_labels, maxIter=1, maxDepth=2)
    assert isinstance(model, PipelineModel)
    kept = models.predict_bounces(t.track, model, smooth=False)
    assert "UDF" not in plan(kept) and "_x_diff_1" not in plan(kept)
    scored = models.score_features(bounce.bounce_features(t.track, keep_chunk=True), model)
    assert sorted(kept.collect()) == sorted(bounce.suppress_runs(scored.select("video_id", "frame", "_chunk", "score")).collect())


def test_hits_with_their_probability(spark):
    t = Samples(spark, SF)
    model = models.fit_hit_model(t.track, t.bounce_labels, maxIter=1, maxDepth=2)
    both = models.predict_hits(t.track, model, threshold=0.3, probability="p")
    assert both.columns == ["video_id", "frame", "p", "hit"] and "Join" not in plan(both)
    alone = {r["frame"]: r["hit"] for r in models.predict_hits(t.track, model, threshold=None).collect()}
    assert {r["frame"]: r["p"] for r in both.collect()} == alone
    assert all(r["hit"] == int(r["p"] > 0.3) for r in both.collect())
