"""The chain of a micro-batch: scores of the touched companies, contagion, composite signals, alerts (survey N5)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators import route, score
from riskloom.sources.shared import kept

SCORES = "cin string, score double, band string"


@dataclass
class Monitor:
    """Tables of what is known and of what has been concluded, in a folder: each micro-batch writes into its own folder of
    each table and reads only what earlier ones have written, so that one that is run again replaces its own results.

    events (id, cin, event_type, severity, detected_at, data_json) come from the stream; master, edges, cases, snapshots and
    watchlists are those of the batch operators. as_of: the day of the scores.
    """

    path: str
    master: DataFrame
    edges: DataFrame
    cases: DataFrame
    snapshots: DataFrame
    watchlists: DataFrame
    as_of: Column
    depth: int = 2

    def _write(self, df: DataFrame, name: str, batch: int) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{self.path}/{name}/batch={batch}")

    def table(self, name: str, upto: int | None = None) -> DataFrame:
        """All rows of a table, or those of the batches up to a number."""
        df = self.master.sparkSession.read.parquet(f"{self.path}/{name}")
        return df if upto is None else df.filter(F.col("batch") <= upto)

    def scores(self, upto: int | None = None) -> DataFrame:
        """The newest score and band of every company, without contagion."""
        last = self.table("scores", upto).groupBy("cin").agg(F.max_by(F.struct("score", "band"), "batch").alias("s"))
        return last.select("cin", "s.score", "s.band")

    def start(self, events: DataFrame) -> None:
        """Scores every company by the events that are there before the stream; the other tables start empty."""
        self._write(score.weigh(score.components(self.master, self.edges, self.cases, self.snapshots, events, self.as_of)).select("cin", "score", "band"), "scores", -1)
        self._write(events, "events", -1)
        none = events.limit(0)
        self._write(none.select("cin", F.lit("").alias("rule"), F.lit("").alias("severity"), "detected_at"), "composites", -1)

    def run(self, batch: DataFrame, number: int) -> None:
        """One micro-batch, for foreachBatch. Only the touched companies, their boards' companies up to `depth` levels where
        a band has changed, and the touched companies' own events are read through; nothing comes to the driver but a time."""
        new = self._write(batch, "events", number)
        touched = kept(new.select("cin").distinct())
        mine = lambda df: df.join(touched, "cin", "left_semi")
        known = kept(mine(self.table("events", number).drop("batch")))
        parts = score.components(mine(self.master), mine(self.edges), mine(self.cases), mine(self.snapshots), known, self.as_of)
        now = self._write(score.weigh(parts).select("cin", "score", "band"), "scores", number)
        before = self.scores(number - 1)
        changed = now.join(before.select("cin", F.col("band").alias("was")), "cin").filter("band <> was").select("cin")
        reached = score.propagate(kept(self.scores(number)), self.edges, kept(changed), kept, self.depth)
        self._write(reached, "contagion", number)
        at = new.agg(F.max("detected_at")).first()[0]
        if at is None:
            return
        at = F.lit(at)
        found = score.combine_signals(known, self.master, at, fired=self.table("composites", number - 1).select("cin", "rule", "detected_at"), new=new.select("cin", "event_type"))
        self._write(found.select("cin", "rule", "severity", at.alias("detected_at")), "composites", number)
        self._write(route.match_watchlists(new, self.watchlists, self.master).select("event_id", "watchlist_id", "cin", "severity"), "alerts", number)


def scored_batches(stream: DataFrame, checkpoint: str, score_: Callable[[DataFrame, int], None]):
    """Each micro-batch's events go to a function of the batch and its number; returns the writer."""
    return stream.writeStream.foreachBatch(score_).option("checkpointLocation", checkpoint)
