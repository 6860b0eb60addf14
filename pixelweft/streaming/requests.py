"""Streaming forms of the interaction rules: debounce by session windows, latest wins and the edit log by keyed state that expires."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.edits import stand


def debounced_stream(changes: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "350 milliseconds", late: str = "10 seconds", value: str = "payload") -> DataFrame:
    """The last change of each burst, once the watermark has passed the pause after it."""
    w = F.session_window(ts, gap)
    out = changes.withWatermark(ts, late).groupBy(w.alias("w"), key).agg(F.max_by(value, F.struct(ts, value)).alias(value), F.count("*").alias("changes"))
    return out.select(key, F.col("w.start").alias("first_ts"), value, "changes")


#: Event time that the watermark has to be past a key's last batch before its state goes.
KEEP_MS = 24 * 3600 * 1000


def latest_stream(results: DataFrame, key: str = "user_id", request: str = "req_id", payload: str = "payload", ts: str = "ts", late: str = "10 seconds", keep_ms: int = KEEP_MS) -> DataFrame:
    """Results (key, request, payload; ts) of which none is older than one seen before for its key.

    The state is one number a key and goes once the watermark of ts is keep_ms past where
    it stood at the key's last result; what comes later than that counts as the first one.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        kept = []
        for pdf in batches:
            for r, p in pdf.sort_values(request)[[request, payload]].itertuples(index=False):
                if last is None or r > last:
                    last = r
                    kept.append((k[0], r, p))
        if last is not None:
            state.update((int(last),))
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + keep_ms)
        # of one batch only the newest counts
        yield pd.DataFrame(kept[-1:], columns=[key, request, payload])

    return results.withWatermark(ts, late).groupBy(key).applyInPandasWithState(run, f"{key} long, {request} long, {payload} string", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def edit_log_stream(log: DataFrame, ts: str = "ts", late: str = "10 seconds", keep_ms: int = KEEP_MS) -> DataFrame:
    """log (image_id long, seq long, op, action long, ts) as a stream -> image_id, seq and actions (what stands) after each micro-batch that touches an image.

    The state of an image is what is done and what may be redone, and the last seq; steps
    that come again or too late (seq not above it) change nothing, so any split into
    micro-batches that keeps an image's order ends with what edit_log() finds. It goes
    as that of latest_stream().
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        done, undone, last = state.get if state.exists else ([], [], -(1 << 62))
        new = pd.concat(list(batches)).sort_values("seq").drop_duplicates("seq")
        new = new[new.seq > last]
        done, undone = stand(list(done), list(undone), new[["op", "action"]].itertuples(index=False))
        last = int(new.seq.max()) if len(new) else last
        state.update(([int(a) for a in done], [int(a) for a in undone], last))
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + keep_ms)
        yield pd.DataFrame({"image_id": [k[0]], "seq": [last], "actions": [[int(a) for a in done]]})

    return log.withWatermark(ts, late).groupBy("image_id").applyInPandasWithState(run, "image_id long, seq long, actions array<long>", "done array<long>, undone array<long>, last long", "update", GroupStateTimeout.EventTimeTimeout)
