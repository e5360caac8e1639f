"""A run that is killed goes on without doing again what was done; versions that were cut short don't count."""

import pytest
from pyspark.sql import functions as F

from trackweave.sources.ledger import Batch, Ledger


@pytest.fixture
def ledger(spark, tmp_path):
    return Ledger(spark, f"file://{tmp_path}/ledger")


def units(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "unit string")


def states(ledger):
    return {r["unit"]: (r["state"], r["tries"]) for r in ledger.states().collect()}


class Killed(BaseException):
    """As a process that ends: no handler of errors sees it."""


def test_killed_run_goes_on(spark, ledger, tmp_path):
    done = []
    out = f"file://{tmp_path}/out"

    def work(some):
        for u in some:
            if u == "s4" and "s4" not in done:
                done.append("s4")
                spark.range(5).write.mode("overwrite").parquet(f"{out}/unit={u}")
                raise Killed
            done.append(u)
            spark.range(5).write.mode("overwrite").parquet(f"{out}/unit={u}")

    names = [f"s{k}" for k in range(6)]
    ledger.start(units(spark, *names))
    with pytest.raises(Killed):
        ledger.run(work, every=2)
    assert {u for u, (s, _) in states(ledger).items() if s == "done"} == {"s0", "s1", "s2", "s3"}
    with pytest.raises(RuntimeError, match=r"s4 \(pending\), s5"):
        ledger.gate()
    again = Ledger(spark, ledger.path)
    again.start(units(spark, *names, "s6"), outputs=spark.read.parquet(out).filter("id = 4").select("unit"))
    assert again.todo() == ["s5", "s6"]
    again.run(work, every=2)
    again.gate()
    assert done == ["s0", "s1", "s2", "s3", "s4", "s5", "s6"]


def test_failures_are_alone_and_tried_again(spark, ledger):
    broken = {"b"}

    def work(some):
        if broken & set(some):
            raise ValueError("no depth")

    ledger.start(units(spark, "a", "b", "c"))
    ledger.run(work, every=3)
    assert states(ledger) == {"a": ("done", 1), "b": ("failed", 1), "c": ("done", 1)}
    assert ledger.states().filter("unit = 'b'").first()["note"] == "no depth" and ledger.todo(retry=False) == []
    broken.clear()
    ledger.run(work)
    assert states(ledger)["b"] == ("done", 2)
    ledger.gate()


def test_version_cut_short(spark, ledger):
    assert ledger.states().collect() == [] and ledger.todo() == []
    ledger.start(units(spark, "a", "b"))
    ledger.record(["a"], "done")
    spark.createDataFrame([("a", "failed", 9, None, 2)], "unit string, state string, tries int, note string, size long").write.parquet(f"{ledger.path}/version=7")
    assert states(ledger) == {"a": ("done", 1), "b": ("pending", 0)}
    ledger.record(["b"], "done")
    assert states(ledger) == {"a": ("done", 1), "b": ("done", 1)}


def test_batch_goes_on_and_merges(spark, tmp_path):
    """Five videos two at a time: one is missing, one fails, and the run is killed once; rows of unfinished videos stay as they were."""
    rows = spark.createDataFrame([(v, k, "old") for v in range(5) for k in range(3)], "video_id int, k int, v string")
    available, calls, state = rows.select("video_id").filter("video_id <> 4"), [], {"kill": True}

    def work(some):
        videos = sorted({r["video_id"] for r in some.select("video_id").collect()})
        calls.append(videos)
        if 2 in videos and state["kill"]:
            raise Killed
        if 1 in videos:
            raise ValueError("broken")
        return some.filter("k < 2").withColumns({"v": F.lit("new"), "state": F.col("k") * 10})

    batch = Batch(spark, f"file://{tmp_path}/b")
    with pytest.raises(Killed):
        batch.run(rows, available, work, every=2)
    see = lambda: {v: sorted((r["k"], r["v"], r["state"]) for r in batch.result(rows).filter(f"video_id = {v}").collect()) for v in range(5)}
    new, old = [(0, "new", 0), (1, "new", 10)], [(k, "old", None) for k in range(3)]
    assert see() == {0: new, 1: old, 2: old, 3: old, 4: old}
    state["kill"] = False
    batch.run(rows, available, work, every=2)
    assert see() == {0: new, 1: old, 2: new, 3: new, 4: old}
    assert calls == [[0, 1], [0], [1], [2, 3], [1, 2], [1], [2], [3]]
    assert batch.ledger.states().filter("state = 'failed'").first()["unit"] == "1"
