"""A store of episodes: four Parquet tables in one folder, written append-only.

``sessions``, ``episodes``, ``episode_members`` and ``episode_supersessions``. Recording skips what is
there, by an anti-join on keys, so recording twice changes nothing. Only a first supersession of an
episode counts; a later one may fill in its missing time, as one more row, and readers take the first
write and the first known time. Runs of one writer at a time, as Parquet folders need.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TABLES = {
    "sessions": "session string, started long, ended long",
    "episodes": "id string, session string, started long, ended long, register string, trust string, summary string, closed_by string",
    "episode_members": "id string, path string, role string, ordinal int",
    "episode_supersessions": "old_id string, new_id string, reason string, source_at long, written long",
}
KEYS = {"sessions": ["session"], "episodes": ["id"], "episode_members": ["id", "path"]}


@dataclass
class EpisodeStore:
    """An open store; ``close`` forgets the session, not the data."""

    spark: SparkSession | None
    path: str
    written: int = 0

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> EpisodeStore:
        """Opens the store in a folder, making the tables that are missing; columns that older files lack read as null."""
        store = cls(spark, path.rstrip("/"))
        for name, schema in TABLES.items():
            if not store.has(name):
                spark.createDataFrame([], schema).write.mode("append").parquet(f"{store.path}/{name}")
        last = store.table("episode_supersessions").agg(F.max("written")).first()[0]
        store.written = 0 if last is None else int(last) + 1
        return store

    def close(self) -> None:
        self.spark = None

    def has(self, name: str) -> bool:
        """Whether a table exists; whatever goes wrong in looking means that it does not."""
        try:
            self._open().read.parquet(f"{self.path}/{name}").limit(0).count()
        except Exception:  # noqa: BLE001  # a missing folder, an unreadable file and a lost store are all "no"
            return False
        return True

    def _open(self) -> SparkSession:
        if self.spark is None:
            raise ValueError("the store is closed")
        return self.spark

    def table(self, name: str) -> DataFrame:
        return self._open().read.schema(TABLES[name]).parquet(f"{self.path}/{name}")

    def _append(self, name: str, rows: DataFrame) -> int:
        """Writes the rows, one a key, that the table does not hold; tells how many."""
        keys, types = KEYS[name], {c.split()[0]: c.split()[1] for c in TABLES[name].split(", ")}
        fresh = rows.select(*(F.col(c).cast(t).alias(c) for c, t in types.items())).dropDuplicates(keys)
        fresh = fresh.join(self.table(name).select(*keys), keys, "left_anti").select(*types)
        before = self.table(name).count()
        fresh.write.mode("append").parquet(f"{self.path}/{name}")
        return self.table(name).count() - before

    def record(self, episodes: DataFrame, members: DataFrame) -> tuple[int, int]:
        """Adds episodes (id, session, started, ended, ...) with their members; tells how many were new and how many known.

        Sessions come from the episodes. Times that are not known stay null. Members of a known episode
        are still added where they are missing.
        """
        total = episodes.select("id").distinct().count()
        sessions = episodes.groupBy("session").agg(F.min("started").alias("started"), F.max("ended").alias("ended"))
        self._append("sessions", sessions)
        new = self._append("episodes", episodes)
        self._append("episode_members", members)
        return new, total - new

    def supersede(self, edges: DataFrame) -> int:
        """Adds (old_id, new_id, reason, source_at): the first write of an old_id wins, later ones only bring a missing time.

        An episode does not supersede itself. Tells how many rows were written.
        """
        now = self.supersessions().select(F.col("old_id"), F.col("new_id").alias("had"), F.col("source_at").alias("had_at"))
        one = edges.where("old_id <> new_id").dropDuplicates(["old_id"]).join(now, "old_id", "left")
        useful = one.where(F.col("had").isNull() | ((F.col("had") == F.col("new_id")) & F.col("had_at").isNull() & F.col("source_at").isNotNull()))
        rows = useful.select("old_id", "new_id", "reason", F.col("source_at").cast("long").alias("source_at"), F.lit(self.written).cast("long").alias("written"))
        before = self.table("episode_supersessions").count()
        rows.write.mode("append").parquet(f"{self.path}/episode_supersessions")
        self.written += 1
        return self.table("episode_supersessions").count() - before

    def supersessions(self) -> DataFrame:
        """(old_id, new_id, reason, source_at): the first write of each, with the first known time."""
        g = self.table("episode_supersessions").groupBy("old_id").agg(F.min(F.struct("written", "new_id", "reason")).alias("first"), F.min_by("source_at", F.when(F.col("source_at").isNotNull(), F.col("written"))).alias("source_at"))
        return g.select("old_id", "first.new_id", "first.reason", "source_at")

    def recall(self, paths: list[str], budget: int = 6000, served: DataFrame | None = None) -> DataFrame:
        """Cards of episodes that touched any of the paths, newest first, those of unknown time last, while they fit a budget.

        Superseded and already served episodes are left out. A card costs its summary, its paths and 40.
        """
        hits = self.table("episode_members").where(F.col("path").isin(paths)).groupBy("id").agg(F.array_sort(F.collect_set("path")).alias("matched"))
        hits = hits.join(self.supersessions().select(F.col("old_id").alias("id")), "id", "left_anti")
        if served is not None:
            hits = hits.join(served.select("id").distinct(), "id", "left_anti")
        cards = hits.join(self.table("episodes"), "id").withColumn("chars", F.length(F.coalesce("summary", F.lit(""))).cast("long") + F.length(F.array_join("matched", ",")) + 40)
        best = (F.desc_nulls_last("ended"), F.desc("id"))
        # no more cards than these can fit, so the window sees a top-k
        order = W.orderBy(*best)
        some = cards.orderBy(*best).limit(budget // 40 + 1).withColumn("rank", F.row_number().over(order)).withColumn("used", F.sum("chars").over(order.rowsBetween(W.unboundedPreceding, 0)))
        return some.where(F.col("used") <= budget).select("rank", "id", "session", "ended", "summary", F.array_join("matched", ",").alias("matched"))
