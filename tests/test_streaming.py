import datetime as dt
import random

import pytest

from pixelweft.operators import edits
from pixelweft.streaming import requests
from pixelweft.streaming.requests import debounced_stream, latest_stream


def drained(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert not q.isActive
    return df.sparkSession.table(name).collect()


def test_debounce_and_latest(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, 1, t, "a"), (1, 2, t + dt.timedelta(milliseconds=200), "b"), (1, 3, t + dt.timedelta(seconds=5), "c"), (2, 9, t + dt.timedelta(minutes=5), "z")]
    schema = "user_id long, req_id long, ts timestamp, payload string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    assert {(r.user_id, r.payload, r.changes) for r in drained(debounced_stream(stream), "bursts")} == {(1, "b", 2), (1, "c", 1)}
    assert {(r.user_id, r.req_id, r.payload) for r in drained(latest_stream(stream), "latest")} == {(1, 3, "c"), (2, 9, "z")}


@pytest.mark.parametrize("size", [23, 200])
def test_edit_log_in_any_split_is_that_of_the_whole(spark, tmp_path, size):
    """Micro-batches of so many steps, some of which come twice, end with what the batch operator finds."""
    r = random.Random(size)
    rows = [((1 << 40) + r.randrange(3), i, r.choice(["add", "add", "undo", "redo", "add", "undo", "clear" if i % 50 == 0 else "add"]), i) for i in range(200)]
    schema = "image_id long, seq long, op string, action long"
    for n, at in enumerate(range(0, 200, size)):
        spark.createDataFrame(rows[max(0, at - 3) : at + size], schema).selectExpr("*", "timestamp_seconds(1704067200 + seq) AS ts").coalesce(1).write.mode("append").json(str(tmp_path / "in" / f"{n:03d}"))
    stream = spark.readStream.schema(schema + ", ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(str(tmp_path / "in"))
    found = {}

    def keep(batch, _):
        for x in batch.collect():
            found[x.image_id] = max(found.get(x.image_id, (-1, [])), (x.seq, list(x.actions)))

    requests.edit_log_stream(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(100)
    want = {}
    for x in edits.edit_log(spark.createDataFrame(rows, schema)).orderBy("image_id", "pos").collect():
        want.setdefault(x.image_id, []).append(x.action)
    assert {k: v[1] for k, v in found.items() if v[1]} == want
