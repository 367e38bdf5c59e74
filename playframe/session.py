"""Runs as a whole: what is there, what follows from it, and questions to the results.

A session holds the observations of any number of runs and a folder for what is made of
them. ``recompute`` makes names, distances and intervals as stages of a ledger: each
writes its tables once for what went in, the next reads them, a second call reads what
is there, and all runs go through one plan.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playframe.operators import frames as fr
from playframe.operators import handoffs, heatmaps, identity, observed
from playframe.operators.aggregates import majority
from playframe.sources import ledger

#: Tables of a session and the columns that they need.
TABLES = {
    "persons": "run_id segment_id track_id frame_index timestamp_s included role x y position_status ground_point_method box color",
    "frames": "run_id segment_id frame_index timestamp_s included scene_cut",
    "reads": "run_id segment_id track_id frame_index number confidence",
    "roster": "team number name",
}
METRICS = ("presence", "movement")


def work_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: ``spark.checkpoint.dir``, or a local one where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return found.rstrip("/") if found else "file://" + tempfile.mkdtemp(prefix="playframe-")


class Session:
    """Observations of runs and what is made of them."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], folder: str | None = None, tau: float = 0.12, deadband: float = 0.025):
        for name, columns in TABLES.items():
            missing = set(columns.split()) - set(tables[name].columns)
            if missing:
                raise ValueError(f"{name} lacks {', '.join(sorted(missing))}")
        self.spark, self.tables, self.settings = spark, tables, {"tau": tau, "deadband": deadband}
        self.folder = folder or work_folder(spark)
        self._made: dict[str, DataFrame] | None = None

    # --- what is there

    def runs(self) -> DataFrame:
        """Per run its frames, included frames, segments and seconds."""
        return self.tables["frames"].groupBy("run_id").agg(F.count(F.lit(1)).alias("frames"), F.count(F.when(F.col("included"), 1)).alias("included"), F.count_distinct("segment_id").alias("segments"), (F.max("timestamp_s") - F.min("timestamp_s")).alias("seconds"))

    def run(self, run_id) -> Session:
        """The same session with one run only; what is made of it is kept apart."""
        one = {n: t.where(F.col("run_id") == run_id) if "run_id" in t.columns else t for n, t in self.tables.items()}
        return Session(self.spark, one, f"{self.folder}/run={run_id}", **self.settings)

    def frames(self, start: int, count: int = 60) -> DataFrame:
        """A page of frames of every run, with their persons as an array."""
        frame = fr.page(self.tables["frames"], start, count)
        own = self.tables["persons"].where(F.col("frame_index").between(start, start + count - 1))
        persons = own.groupBy("run_id", "frame_index").agg(F.sort_array(F.collect_list(F.struct("track_id", "role", "x", "y", "color"))).alias("persons"))
        return frame.join(persons, ["run_id", "frame_index"], "left").orderBy("run_id", "frame_index")

    def reads(self, segment: int | None = None, track: int | None = None) -> DataFrame:
        rows = self.tables["reads"]
        rows = rows if segment is None else rows.where(F.col("segment_id") == segment)
        return rows if track is None else rows.where(F.col("track_id") == track)

    # --- what follows

    def recompute(self) -> dict[str, DataFrame]:
        """``known`` (frames with a name), ``contributions``, ``statistics`` and ``intervals``; made once for what goes in."""
        if self._made is None:
            inputs = {n: ledger.table_fingerprint(t.select(*TABLES[n].split())) for n, t in self.tables.items()}
            made: dict[str, DataFrame] = {}
            for name, make in (("names", self._names), ("distances", self._distances), ("intervals", self._intervals)):
                tables, _ = ledger.stage(self.spark, self.folder, name, self.settings, inputs, lambda make=make: make(made))
                made |= tables
            self._made = made
        return self._made

    def _names(self, made: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """From readings and colours to the frames on which a track's player is known, directly or handed on."""
        persons, reads = self.tables["persons"], self.tables["reads"]
        track = identity.tracks_of(persons)
        votes = persons.where("role = 'player' and track_id is not null and color is not null").select(*track, "frame_index", "color")
        counts = votes.groupBy(*track, "color").agg(F.count(F.lit(1)).alias("_n")).groupBy(*track).agg(F.map_from_entries(F.collect_list(F.struct("color", "_n"))).alias("counts"))
        teams = majority(votes, track, "color", "frame_index", min_votes=3, min_share=0.8).select(*track, F.col("winner").alias("team"))
        teams = counts.join(teams, track, "left").withColumn("mixed", F.size("counts") > 1).select(*track, "team", "mixed", "counts")
        assigned = identity.assignments(reads, self.tables["roster"], teams, votes)
        direct = identity.direct_spans(identity.spans(persons.drop("color")), assigned.select(*track, "team", "number"), votes).select(*track, "frame_index", "team", "number")
        cuts = self.tables["frames"].where("scene_cut").select("run_id", "segment_id", "frame_index")
        return {"known": handoffs.known_frames(persons, direct, handoffs.links(persons, direct, cuts, reads))}

    def _distances(self, made: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Distances replayed with the names: the same persons, named where a track is known."""
        rows = observed.contributions(self._named(made["known"]), **self.settings)
        return {"contributions": rows.drop("box"), "statistics": observed.statistics(rows).withColumn("excluded", F.map_entries("excluded"))}

    def _intervals(self, made: dict[str, DataFrame]) -> dict[str, DataFrame]:
        rows = self._named(made["known"])
        plans = heatmaps.plans(self.tables["frames"]).select("run_id", "frame_index", "plan")
        team = F.coalesce("named.team", "color")
        subject = F.when(F.col("named").isNotNull(), F.concat_ws(":", F.lit("roster"), "named.team", "named.number"))
        found = heatmaps.intervals(rows.join(plans, ["run_id", "frame_index"]).withColumn("team", team).withColumn("subject", subject))
        return {"intervals": heatmaps.with_distance(found, made["contributions"])}

    def _named(self, known: DataFrame) -> DataFrame:
        who = known.select("run_id", "segment_id", "track_id", "frame_index", F.struct("team", "number").alias("named"))
        return self.tables["persons"].join(who, ["run_id", "segment_id", "track_id", "frame_index"], "left")

    # --- questions

    def leaderboard(self, frame: int) -> DataFrame:
        return observed.metrics_at(self.recompute()["contributions"], frame)

    def heatmap(self, *, team: str | None = None, subject: str | None = None, start: float = 0.0, end: float = float("inf"), metric: str = "presence", zones: bool = False, length: float = 28.65, width: float = 15.24) -> tuple[DataFrame, DataFrame]:
        """Grid and totals per run of a team or of a subject; exactly one of both is asked for."""
        if (team is None) == (subject is None):
            raise ValueError("ask for a team or for a subject")
        if metric not in METRICS:
            raise ValueError(f"a metric is one of {', '.join(METRICS)}")
        if not 0 <= start < end:
            raise ValueError("a range begins at 0 or later and isn't empty")
        if subject is not None and self.tables["roster"].where(F.concat_ws(":", F.lit("roster"), "team", "number") == subject).limit(1).count() == 0:
            raise ValueError(f"{subject} isn't in the roster")
        rows = self.recompute()["intervals"]
        rows = rows.where(F.col("team") == team) if team is not None else rows.where(F.col("subject") == subject)
        return heatmaps.heatmap(rows, ["run_id"], start, min(end, 1e9), length, width, metric=metric, zones=zones)


def recompute(spark: SparkSession, tables: dict[str, DataFrame], folder: str | None = None, **settings) -> dict[str, DataFrame]:
    """All results of all runs of ``tables`` in one call."""
    return Session(spark, tables, folder, **settings).recompute()
