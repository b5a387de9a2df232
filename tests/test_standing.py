"""What stands, as a stream: any order of changes ends where the whole table does; repeals that are withdrawn revive."""

import random
import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tempora.session import shared_dir
from tempora.streaming import standing as S

DAY = datetime(2025, 1, 1)


def run(spark, batches):
    folder = f"{shared_dir(spark)}/standing-{uuid.uuid4().hex}"
    for rows in batches:
        spark.createDataFrame(rows, S.CHANGES).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(S.CHANGES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return S.replayed(spark, S.standing(stream, "100 days"), folder)


def change(unit, id, kind, day, target=None, ts=0):
    return unit, id, kind, DAY + timedelta(days=day), target, DAY + timedelta(days=ts)


def test_a_withdrawn_repeal_revives(spark):
    tick = lambda ts: change("~", f"t{ts}", "text", 9999, None, ts)
    # A batch is judged by the watermark that the one before it left.
    rows = run(spark, [[change("u", "a", "text", 1), change("u", "r", "repeal", 5), tick(103)], [tick(110)], [tick(111)], [change("u", "w", "withdraw", 6, "r", 110), tick(115)], [change("u", "b", "text", 90, None, 115), tick(195)]])
    got = [(r["n"], r["status"], r["id"]) for r in rows.where("unit = 'u'").orderBy("n").collect()]
    assert got == [(1, "in_force", "a"), (2, "repealed", "r"), (3, "in_force", "a"), (4, "in_force", "b")]


def test_any_order_ends_alike(spark):
    deal = random.Random(3)
    rows = []
    for n in range(120):
        kind = deal.choice(["text", "text", "repeal", "withdraw"])
        rows.append(change(f"u{n % 12}", f"c{n:03d}", kind, deal.randint(0, 60), f"c{n - 12 * deal.randint(1, 3):03d}" if kind == "withdraw" else None, deal.randint(0, 20)))
    end = [change("~", "t", "text", 9999, None, 130)]
    want = {tuple(r) for r in S.standing_at(spark.createDataFrame(rows + end, S.CHANGES), F.lit(DAY + timedelta(days=30))).collect()}
    assert len(want) > 8
    deal.shuffle(rows)
    rows = rows + rows[:5]  # repeats
    got = S.last_given(run(spark, [rows[:40], rows[40:90], rows[90:] + end])).collect()
    assert {tuple(r) for r in got} == want
