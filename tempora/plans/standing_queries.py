"""The event table as a stream of texts, repeals and withdrawals."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.plans.catalog import query
from tempora.session import shared_dir
from tempora.streaming import standing as S
from tempora.streaming.changes import read_events


@query("""WITH c AS (SELECT 'u' || event_id // 20 AS unit, event_id AS id, CASE event_type WHEN 'error' THEN 'repeal' WHEN 'signup' THEN 'withdraw' ELSE 'text' END AS kind, CAST(ts AS DATE) + CAST(event_id % 40 AS INTEGER) AS valid_from, event_id - 1 - event_id % 3 AS target FROM events),
d AS (SELECT * FROM c WHERE valid_from <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)),
l AS (SELECT * FROM d WHERE kind <> 'withdraw' AND NOT EXISTS (SELECT 1 FROM d w WHERE w.kind = 'withdraw' AND w.unit = d.unit AND w.target = d.id))
SELECT unit, CASE WHEN kind = 'text' THEN 'in_force' ELSE 'repealed' END AS status, lpad(CAST(id AS VARCHAR), 12, '0') AS id FROM l QUALIFY row_number() OVER (PARTITION BY unit ORDER BY valid_from DESC, id DESC) = 1""")
def standing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands of each unit after all events went through the stream, which runs while this plan is built."""
    name = lambda c: F.lpad(c.cast("string"), 12, "0")
    event = F.col("event_id")
    kind = F.when(F.col("event_type") == "error", "repeal").when(F.col("event_type") == "signup", "withdraw").otherwise("text")
    valid = F.date_add(F.to_date("ts"), (event % 40).cast("int")).cast("timestamp")
    target = F.when(F.col("event_type") == "signup", name(event - 1 - event % 3))
    changes = read_events(spark, sf_dir).select(F.concat(F.lit("u"), F.floor(event / 20).cast("string")).alias("unit"), name(event).alias("id"), kind.alias("kind"), valid.alias("valid_from"), target.alias("target"), "ts")
    return S.last_given(S.replayed(spark, S.standing(changes, "1 hour"), f"{shared_dir(spark)}/standing-{uuid.uuid4().hex}"))
