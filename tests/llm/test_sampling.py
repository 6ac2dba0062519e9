"""Samples for fits: never rounded to nothing, hot values folded."""

import math

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import urltrees
from lodestrata.llm.scratch import sampled


def test_shares_below_a_millionth_still_draw(spark):
    rows = spark.range(20_000).withColumn("at", F.xxhash64("id"))
    low = rows.where(F.col("at").bitwiseAND((1 << 20) - 1) < int(0.01 * (1 << 20)))
    drawn = sampled(rows, F.col("at"), 1_000_000, 10_000)  # a share of a hundredth
    assert low.join(drawn, "id", "left_anti").isEmpty() and drawn.count() - low.count() <= 1
    # no row falls below a share this small, so it is taken of the values
    assert 50 <= sampled(rows, F.col("at"), 10**14, 100).count() <= 200
    assert sampled(rows, F.col("at"), 20_000, 20_000).count() == 20_000


def test_few_values_that_repeat(spark):
    rows = spark.range(5_000).select(F.xxhash64(F.lit("one")).alias("at"))
    assert sampled(rows, F.col("at"), 5_000, 10).count() == 5_000
    with pytest.raises(ValueError, match="no row was drawn"):
        sampled(rows.where("false"), F.col("at"), 5_000, 10)


def test_a_hot_url_is_one_weighted_row(spark):
    hot = [("http://hot.net/x", "hot.net", "/x", "block")] * 3_000
    rest = [(f"http://h{k}.org/fr/{k}", f"h{k}.org", f"/fr/{k}", "allow") for k in range(200)]
    model = urltrees.fit(spark.createDataFrame(hot + rest, "url string, host string, path string, verdict string"))
    assert model.base == pytest.approx(3_000 / 3_200)
    assert model.prior == pytest.approx(math.log(3_000.5 / 200.5))
    assert model.score([hot[0][:3]])[0] > 0.9 > 0.5 > model.score([rest[0][:3]])[0]


def test_weights_equal_repeats(spark):
    rows = [(f"http://a{k % 7}.net/{'9' * (k % 5)}?x={k}", f"a{k % 7}.net", f"/{'9' * (k % 5)}", int(k % 5 > 2)) for k in range(60)]
    once = urltrees.train(rows)
    weighted = urltrees.train([(*r, 1) for r in rows])
    assert once.score([r[:3] for r in rows]).tolist() == weighted.score([r[:3] for r in rows]).tolist()
