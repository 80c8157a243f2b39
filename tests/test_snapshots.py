"""Commits of the score log, stopped between every two of their steps."""
import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from conftest import T0
from riskloom.sources import snapshots as SN

DAY = dt.timedelta(days=1)


def _scores(spark, rows):
    return spark.createDataFrame(rows, "transaction_id string, fraud_score double, scored_at timestamp")


def _state(spark, path, number=None):
    return sorted((r.transaction_id, r.fraud_score, str(r.score_date)) for r in SN.read(spark, path, number).collect())


@pytest.fixture
def log(spark, tmp_path):
    path = str(tmp_path / "log")
    assert SN.read(spark, path) is None
    SN.commit(spark, _scores(spark, [("a", 0.1, T0), ("b", 0.2, T0), ("c", 0.3, T0 + 5 * DAY), ("n", 0.4, None)]), path)
    return path


def test_commits_replace_by_id_across_days(spark, log):
    d0, d1, d5 = (str((T0 + k * DAY).date()) for k in (0, 1, 5))
    first = [("a", 0.1, d0), ("b", 0.2, d0), ("c", 0.3, d5), ("n", 0.4, "None")]
    assert _state(spark, log) == first
    SN.commit(spark, _scores(spark, [("a", 0.5, T0 + DAY), ("d", 0.1, T0 + DAY), ("d", 0.9, T0 + DAY + dt.timedelta(minutes=1))]), log)
    assert _state(spark, log) == [("a", 0.5, d1), ("b", 0.2, d0), ("c", 0.3, d5), ("d", 0.9, d1), ("n", 0.4, "None")]
    assert SN.commit(spark, _scores(spark, [("c", 0.4, T0), ("n", 0.7, T0)]), log) == 3      # two days lose their only row
    assert _state(spark, log) == [("a", 0.5, d1), ("b", 0.2, d0), ("c", 0.4, d0), ("d", 0.9, d1), ("n", 0.7, d0)]
    assert _state(spark, log, 1) == first                     # earlier versions stay readable
    untouched = SN.version(spark, log, 2).days[f"score_date={d1}"]
    assert SN.version(spark, log, 3).days[f"score_date={d1}"] == untouched


def test_a_commit_that_stops_before_its_end_is_not_seen(spark, log, monkeypatch):
    before, new = _state(spark, log), _scores(spark, [("a", 0.9, T0), ("z", 0.9, T0 + 9 * DAY)])
    os.makedirs(f"{log}/{SN.COMMIT}=half/score_date=2024-01-01")              # stopped while writing its rows
    open(f"{log}/{SN.COMMIT}=half/score_date=2024-01-01/part-0.parquet", "wb").write(b"PAR1")
    assert _state(spark, log) == before
    staged = SN.stage(spark, new, log)                                        # stopped before it was published
    assert _state(spark, log) == before
    open(f"{log}/versions/draft-x", "w").write(staged.text()[:10])            # stopped while writing the version
    assert _state(spark, log) == before
    SN.publish(spark, log, staged)
    assert ("a", 0.9) in {s[:2] for s in _state(spark, log)} and len(_state(spark, log)) == 5
    assert SN.clean(spark, log, keep=1, older_than_hours=-1) >= 1             # the half commit goes
    assert len(_state(spark, log)) == 5 and not os.path.exists(f"{log}/{SN.COMMIT}=half")


def test_the_second_of_two_writers_is_refused(spark, log, monkeypatch):
    one, two = (_scores(spark, [(k, 1.0, T0)]) for k in "xy")
    real, names = SN.publish, lambda: {n for n in os.listdir(log) if n.startswith(SN.COMMIT)}

    def late(spark_, path, v):
        monkeypatch.setattr(SN, "publish", real)
        SN.commit(spark, one, log)                        # another writer is faster
        mid.extend(names())
        real(spark_, path, v)

    mid = []
    monkeypatch.setattr(SN, "publish", late)
    with pytest.raises(SN.WriteConflict):
        SN.commit(spark, two, log)
    ids = {s[0] for s in _state(spark, log)}
    assert "x" in ids and "y" not in ids and len(names()) == len(mid) - 1
    assert not [n for n in os.listdir(f"{log}/versions") if n.startswith("draft")]
    SN.commit(spark, two, log)                            # a fresh attempt starts from the new version
    assert {"x", "y"} <= {s[0] for s in _state(spark, log)}


def test_new_columns_and_empty_batches(spark, log):
    SN.commit(spark, _scores(spark, [("q", 0.6, T0)]).withColumn("note", F.lit("late")), log)
    assert {r.transaction_id: r.note for r in SN.read(spark, log).collect()} == {"a": None, "b": None, "c": None, "n": None, "q": "late"}
    before = _state(spark, log)
    SN.commit(spark, _scores(spark, []), log)
    assert _state(spark, log) == before
    empty = log + "-empty"
    SN.commit(spark, _scores(spark, []), empty)
    assert SN.read(spark, empty).count() == 0
