"""Tables with a row per frame aren't broadcast, however small their files are."""

import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("events"))
    events = spark.range(600).selectExpr(
        "id AS event_id", "timestamp_seconds(1700000000 + id * 60) AS ts", "id % 40 AS user_id",
        "element_at(array('click', 'error', 'signup'), CAST(id % 3 AS INT) + 1) AS event_type", "CAST(id AS DOUBLE) AS value",
        "concat('{\"k\": ', id % 50, '}') AS props",
    )
    events.write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["g8_ball_on_mini_court", "g8_players_on_mini_court", "a6_nearest_player", "a7_nearest_court_point"])
def test_no_table_of_frames_is_broadcast(spark, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    assert len(df.collect()) > 0
    assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
