"""Analysts' feedback as an append-only log of Parquet rows; the last row of an entity holds."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "entity_id string, entity_type string, status string, notes string, analyst_id string, updated_at string"
STATUSES = ("PENDING", "CONFIRMED", "FALSE_POSITIVE")


def latest(log: DataFrame) -> DataFrame:
    """One row per entity: its last row's values, but the entity type of its first."""
    per = log.groupBy("entity_id").agg(F.min_by("entity_type", "updated_at").alias("entity_type"), F.max_by(F.struct("status", "notes", "analyst_id", "updated_at"), F.struct("updated_at", "status", "notes")).alias("l"))
    return per.select("entity_id", "entity_type", "l.*")


class FeedbackStore:
    """Feedback under a path that Spark can write."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def set_feedback(self, entity_id: str, status: str, entity_type: str = "wallet", notes: str = "", analyst_id: str = "analyst") -> None:
        status = status.strip().upper()
        if status not in STATUSES:
            raise ValueError(f"status must be one of {', '.join(STATUSES)}")
        now = datetime.now(timezone.utc).isoformat(timespec="microseconds")
        self.spark.createDataFrame([(entity_id, entity_type, status, notes, analyst_id, now)], SCHEMA).write.mode("append").parquet(self.path)

    def _log(self) -> DataFrame:
        """All rows written so far; none before the first."""
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def all(self) -> DataFrame:
        return latest(self._log())

    def get(self, entity_id: str) -> DataFrame:
        return latest(self._log().where(F.col("entity_id") == entity_id))
