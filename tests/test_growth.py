"""A shared store grown workload by workload."""

import pytest
from pyspark.sql import functions as F

from logfold.operators.published import live_folders
from logfold.plans import growth
from logfold.plans.runs import cumulative_runs

SCHEMA = "workload_id long, sig string, bytes long"


def log(spark, workload, sigs):
    return spark.createDataFrame([(workload, s, 10 * len(s) + workload + k) for k, s in enumerate(sigs)], SCHEMA)


def test_workload_by_workload_equals_all_at_once(spark, tmp_path):
    parts = [(w, ["hot"] * 20 + [f"s{k}" for k in range(w, 3 * w + 2)] + [None, "hot"]) for w in range(5)] + [(7, ["hot"])]
    path = str(tmp_path / "store")
    whole = None
    for workload, sigs in parts:
        part = log(spark, workload, [s for s in sigs if s])
        growth.add_workload(part, path, workload)
        whole = part if whole is None else whole.union(part)
        want = {tuple(r) for r in cumulative_runs(whole).select("pipeline", "workload_id", "N", "M", "total_storage").collect()}
        assert {tuple(r) for r in growth.grown(spark, path).collect()} == want


def test_repeated_order_and_empty(spark, tmp_path):
    path = str(tmp_path / "store")
    growth.add_workload(log(spark, 1, ["a", "b"]), path, 1)
    growth.add_workload(log(spark, 2, ["b", "c"]), path, 2)
    once = sorted(growth.grown(spark, path).collect())
    growth.add_workload(log(spark, 2, ["b", "c"]), path, 2)
    assert sorted(growth.grown(spark, path).collect()) == once
    growth.add_workload(log(spark, 3, []), path, 3)
    last = {r.pipeline: (r.N, r.M) for r in growth.grown(spark, path).where("workload_id = 3").collect()}
    assert last == {"A": (0, 4), "B": (0, 3), "C": (0, 3)}
    with pytest.raises(ValueError, match="in order"):
        growth.add_workload(log(spark, 2, ["d"]), path, 2)


def test_a_writer_lost_between_both_tables(spark, tmp_path, monkeypatch):
    """Signatures are published, totals are not: the workload does not count yet, and adding it again is whole."""
    path = str(tmp_path / "store")
    growth.add_workload(log(spark, 1, ["a", "b"]), path, 1)
    publish, calls = growth.publish_batch, []

    def lost(batch, folder, *rest):
        if folder.endswith("steps"):
            raise RuntimeError("lost")
        calls.append(folder)
        publish(batch, folder, *rest)

    monkeypatch.setattr(growth, "publish_batch", lost)
    with pytest.raises(RuntimeError):
        growth.add_workload(log(spark, 2, ["b", "c", "d"]), path, 2)
    monkeypatch.undo()
    assert calls and growth.grown(spark, path).agg(F.max("workload_id")).first()[0] == 1
    growth.add_workload(log(spark, 2, ["b", "c", "d"]), path, 2)
    assert {r.pipeline: r.M for r in growth.grown(spark, path).where("workload_id = 2").collect()} == {"A": 5, "B": 4, "C": 4}
    assert len(live_folders(spark, f"{path}/seen")) == 2
