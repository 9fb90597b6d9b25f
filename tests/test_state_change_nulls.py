from datetime import datetime, timezone

from tessera.streaming import streams as S


def test_a_null_value_is_a_state(spark, tmp_path):
    at = lambda m: datetime(2026, 1, 1, 0, m, tzinfo=timezone.utc)
    values = ["null", "1", "1", "null", "null", "2"]
    rows = [(k, at(k), 1, "a", f'{{"k": {v}}}') for k, v in enumerate(values)] + [(9, at(0), 2, "b", '{"k": 0}')]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, props string").repartition(1).write.parquet(str(tmp_path / "e.parquet"))
    got = {tuple(r) for r in S.drain(S.state_changes(S.events_stream(spark, str(tmp_path / "e.parquet")))).collect()}
    assert got == {(1, "a", 1, None, 1), (1, "a", 3, 1, None), (1, "a", 5, None, 2), (2, "b", 9, None, 0)}
