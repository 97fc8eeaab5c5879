"""O-80, O-81: saved recipes (presets) as a parquet table.

A preset holds the request options only (no fitted statistics), so replaying
it refits every statistic on the new data. Saving appends one row; listing
parses the JSON with ``from_json`` and keeps only rows with a mode (bad JSON
gives a struct of NULLs, not NULL).
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tabclean.plans.request import REQUEST_SCHEMA, CleanRequest

PRESET_SCHEMA = "workflow_id string, name string, created_at timestamp, request string"


def save_preset(spark: SparkSession, store: str, name: str, request: CleanRequest) -> dict:
    row = {
        "workflow_id": str(uuid.uuid4()),
        "name": name.strip(),
        "created_at": dt.datetime.now(dt.timezone.utc).replace(tzinfo=None),
        "request": request.validate().to_json(),
    }
    spark.createDataFrame([tuple(row.values())], PRESET_SCHEMA).write.mode("append").parquet(store)
    return row


def list_presets(spark: SparkSession, store: str) -> DataFrame:
    """Newest first; a missing store lists nothing, and an unreadable file in it is passed over."""
    try:
        raw = spark.read.schema(PRESET_SCHEMA).option("ignoreCorruptFiles", True).parquet(store)
        raw.schema  # noqa: B018  (forces the path check)
    except AnalysisException:
        return spark.createDataFrame([], PRESET_SCHEMA + ", parsed " + REQUEST_SCHEMA.simpleString())
    parsed = raw.withColumn("parsed", F.from_json("request", REQUEST_SCHEMA))
    return parsed.filter(F.col("parsed.mode").isNotNull()).orderBy(F.desc("created_at"))


def load_request(row) -> CleanRequest:
    return CleanRequest.from_json(row["request"])
