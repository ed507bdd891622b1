"""Transition counts over a stream: the last state of each entity is the only state that is kept."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def pairs(events: DataFrame) -> DataFrame:
    """entity, from_state, to_state from a stream of (entity, ts, event_id, state).

    Within a micro-batch events are ordered by (ts, event_id). An event older than the last one of its entity is late
    and gives no pair.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        last = held.get if held.exists else None
        out = []
        for ts, event_id, state in rows[["ts", "event_id", "state"]].itertuples(index=False):
            at = (int(pd.Timestamp(ts).value // 1000), int(event_id), state)
            if last is not None and at[:2] <= tuple(last[:2]):
                continue
            if last is not None:
                out.append((key[0], last[2], state))
            last = at
        if last is not None:
            held.update(last)
        yield pd.DataFrame(out, columns=["entity", "from_state", "to_state"])

    kind = dict(events.dtypes)["entity"]
    return events.groupBy("entity").applyInPandasWithState(step, f"entity {kind}, from_state string, to_state string", "us long, event_id long, state string", "append", GroupStateTimeout.NoTimeout)


def counts(events: DataFrame) -> DataFrame:
    """Running transition counts, for the update or complete output mode of a sink fed by :func:`pairs`."""
    return pairs(events).groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("cnt"))
