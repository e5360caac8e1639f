"""What is done of a batch of units (segments, videos), kept as a table of states, so that a run that was killed goes on where it was.

Each change writes a whole new version, a row a unit and every row with the version's number of rows, to a folder of its own; the state is the last version that is complete. So a
version that a crash cut short is as if it had never been. Only Spark reads and writes, so any store will do.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

PENDING, DONE, FAILED = "pending", "done", "failed"
ROW = "unit string, state string, tries int, note string"


@dataclass(frozen=True)
class Ledger:
    """States of units under `path`. One run at a time changes a ledger."""

    spark: SparkSession
    path: str

    def _versions(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(f"{ROW}, size bigint, version bigint").parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def _last(self) -> int | None:
        found = self._versions()
        if found is None:
            return None
        whole = found.groupBy("version").agg(F.count("*").alias("n"), F.max("size").alias("size")).filter("n = size")
        return whole.agg(F.max("version")).first()[0]

    def states(self) -> DataFrame:
        """unit, state, tries, note of the last complete version; none before start()."""
        last = self._last()
        return self._versions().filter(F.col("version") == last).select("unit", "state", "tries", "note") if last is not None else self.spark.createDataFrame([], ROW)

    def put(self, changes: DataFrame) -> None:
        """The next version: changes (unit, state, note) by unit, others as they are. A change counts as a try unless it sets a unit to pending."""
        held = self.states().withColumnRenamed("tries", "_tries")
        new = changes.groupBy("unit").agg(F.max_by("state", "state").alias("state"), F.max("note").alias("note"))
        tried = new.join(held.select("unit", "_tries"), "unit", "left").select("unit", "state", (F.coalesce("_tries", F.lit(0)) + (F.col("state") != PENDING).cast("int")).alias("tries"), "note")
        rest = held.join(new.select("unit"), "unit", "left_anti").select("unit", "state", F.col("_tries").alias("tries"), "note")
        rows = tried.unionByName(rest).collect()  # a row a unit, at most some thousands
        number = -1 if (found := self._versions()) is None else found.agg(F.max("version")).first()[0]
        out = self.spark.createDataFrame([(*r, len(rows)) for r in rows], f"{ROW}, size bigint").coalesce(1)
        out.write.mode("overwrite").parquet(f"{self.path}/version={(-1 if number is None else number) + 1}")

    def start(self, units: DataFrame, outputs: DataFrame | None = None) -> None:
        """Adds the units (unit) that aren't known, as pending. outputs: units whose results are there, whole, though a crash kept that from being recorded; they become done."""
        known = self.states()
        new = units.select("unit").distinct().join(known, "unit", "left_anti").select("unit", F.lit(PENDING).alias("state"), F.lit(None).cast("string").alias("note"))
        if outputs is not None:
            there = outputs.select("unit").distinct()
            found = known.filter(F.col("state") != DONE).select("unit").unionByName(new.select("unit")).join(there, "unit", "left_semi")
            found = found.select("unit", F.lit(DONE).alias("state"), F.lit("found").alias("note"))
            new = new.join(there, "unit", "left_anti").unionByName(found)
        if not new.isEmpty():
            self.put(new)

    def todo(self, retry: bool = True) -> list[str]:
        """Units to do, in order of their names: pending ones, and with `retry` those that failed."""
        wanted = (PENDING, FAILED) if retry else (PENDING,)
        return sorted(r["unit"] for r in self.states().filter(F.col("state").isin(*wanted)).collect())

    def record(self, units: Iterable[str], state: str, note: str | None = None) -> None:
        rows = [(u, state, note) for u in units]
        if rows:
            self.put(self.spark.createDataFrame(rows, "unit string, state string, note string"))

    def run(self, work: Callable[[list[str]], str | None], every: int = 10, retry: bool = True) -> None:
        """work(units) for `every` units at a time, recorded after each with the note that it returns; of units that fail together each is tried alone, so that one that fails doesn't keep the others from being done.

        work must write a unit's results whole or not at all, and may be called again for a unit whose results are there.
        """
        todo = self.todo(retry)
        for k in range(0, len(todo), every):
            some = todo[k : k + every]
            try:
                self.record(some, DONE, work(some))
            except Exception:  # noqa: BLE001  any failure of the work is the unit's
                for unit in some:
                    try:
                        self.record([unit], DONE, work([unit]))
                    except Exception as e:  # noqa: BLE001
                        self.record([unit], FAILED, str(e)[:500])

    def gate(self) -> None:
        """An error that names the units which failed or are not done; what needs all of them starts with this."""
        left = [f"{r['unit']} ({r['state']})" for r in self.states().filter(F.col("state") != DONE).orderBy("unit").collect()]
        if left:
            raise RuntimeError(f"not all units are done: {', '.join(left)}")


@dataclass(frozen=True)
class Batch:
    """Rows by video, of which some have been worked on: results lie in parts under `path`, and a video's are those of the part that the ledger names. So what is read changes by whole parts, as the ledger does."""

    spark: SparkSession
    path: str

    @property
    def ledger(self) -> Ledger:
        return Ledger(self.spark, f"{self.path}/ledger")

    def run(self, rows: DataFrame, available: DataFrame, work: Callable[[DataFrame], DataFrame], every: int = 10) -> None:
        """work(rows of some videos) for `every` videos at a time, of those in `available` (video_id) that aren't done; its rows (video_id and others) replace theirs. A run that was stopped goes on with the next call."""
        units = available.select(F.col("video_id").cast("string").alias("unit"))
        there = rows.select(F.col("video_id").cast("string").alias("unit")).distinct()
        self.ledger.start(there.join(units, "unit", "left_semi"))

        def one(videos: list[str]) -> str:
            part = uuid.uuid4().hex
            work(rows.filter(F.col("video_id").cast("string").isin(videos))).write.parquet(f"{self.path}/parts/{part}")
            return part

        self.ledger.run(one, every)

    def result(self, rows: DataFrame) -> DataFrame:
        """The rows with those of finished videos replaced; videos that are missing, pending or failed have their own. Columns that only results have are null there."""
        done = self.ledger.states().filter(F.col("state") == DONE).select(F.col("unit").alias("_unit"), F.col("note").alias("_part"))
        rest = rows.withColumn("_unit", F.col("video_id").cast("string")).join(done.select("_unit"), "_unit", "left_anti").drop("_unit")
        parts = sorted(r["_part"] for r in done.select("_part").distinct().collect())
        for part in parts:
            own = self.spark.read.parquet(f"{self.path}/parts/{part}").withColumn("_unit", F.col("video_id").cast("string"))
            rest = rest.unionByName(own.join(done.filter(F.col("_part") == part).select("_unit"), "_unit", "left_semi").drop("_unit"), allowMissingColumns=True)
        return rest
