"""Phase-space points of unbounded streams: the same embedding as for stored series, one micro-batch after another."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_POINT = "series_id string, i long, px double, py double"
_STATE = "i array<bigint>, x array<double>"


def stream_points(signal: DataFrame, tau: int) -> DataFrame:
    """Points (x[i], x[i + tau]) of a stream signal(series_id, i, x); each series keeps its last tau values as state.

    Values of a series must come in the order of i from batch to batch; inside a batch they are sorted.
    """
    if tau < 1:
        raise ValueError("tau is 1 at least")

    def run(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        held_i, held_x = (list(c) for c in state.get) if state.exists else ([], [])
        new = pd.concat(list(frames)).sort_values("i")
        i, x = [*held_i, *new["i"].tolist()], [*held_x, *new["x"].tolist()]
        n = max(0, len(i) - tau)
        state.update((i[-tau:], x[-tau:]))
        yield pd.DataFrame({"series_id": key[0], "i": i[:n], "px": x[:n], "py": x[tau : tau + n]})

    return signal.select("series_id", "i", "x").groupBy("series_id").applyInPandasWithState(run, _POINT, _STATE, "append", GroupStateTimeout.NoTimeout)
