"""Greedy clustering over a stream: the leaders of each category are state that is forgotten after the window."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.clustering import OVERLAP, WINDOW_MS

OUT = "id long, category string, leader long"
STATE = "ids array<long>, ms array<long>, words array<array<string>>"


def _step(window_ms: int, least: int, expires: bool):
    def step(key, batches, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        ids, ms, words = (list(x) for x in state.get) if state.exists else ([], [], [])
        sets, out = [frozenset(w) for w in words], []
        rows = pd.concat(list(batches)).sort_values(["ms", "id"], kind="stable")
        for item, at, kw in zip(rows["id"].tolist(), rows["ms"].tolist(), rows["keywords"]):
            while ids and at - ms[0] > window_ms:
                ids.pop(0), ms.pop(0), sets.pop(0)
            mine = frozenset(kw)
            found = next((k for k, s in enumerate(sets) if len(s & mine) >= least), None)
            out.append((item, key[0], item if found is None else ids[found]))
            if found is None:
                ids.append(item), ms.append(at), sets.append(mine)
        state.update((ids, ms, [sorted(s) for s in sets]))
        if expires and ms:
            state.setTimeoutTimestamp(max(ms[-1] + window_ms, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["id", "category", "leader"])

    return step


def cluster_stream(items: DataFrame, window_ms: int = WINDOW_MS, least: int = OVERLAP, late: str | None = "1 hour") -> DataFrame:
    """(id, category, leader) as items arrive (id, category, ms, keywords). Equal to the batch form if batches come in time
    order; the state of a category is the leaders of one window, and a silent category's state goes once the watermark, late
    behind the newest item, has passed its last leader's window (None: it stays)."""
    rows = items.select("id", "category", "ms", "keywords")
    if late:
        rows = rows.withColumn("_ts", F.timestamp_millis("ms")).withWatermark("_ts", late)
    return rows.groupBy("category").applyInPandasWithState(_step(window_ms, least, bool(late)), OUT, STATE, "append", "EventTimeTimeout" if late else "NoTimeout")
