"""Many streams in one state.

Spark calls Python once for each state and micro-batch, which costs milliseconds, however few rows there are. So streams may be dealt by hash over slots: a slot's
state holds the states of its open streams, and one call takes the rows of all of them.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "streams binary"
#: Streams, and rows of all their micro-batches, of one slot.
STREAMS, ROWS = 256, 4096


def slots_for(streams: int, rows: int = 0) -> int:
    """A number of slots that grows with the streams and their rows, so that what one call holds doesn't."""
    return max(1, -(-streams // STREAMS), -(-rows // ROWS))


def by_slots(rows: DataFrame, keys: list[str], advance: Callable[[tuple | None, list[tuple]], tuple[list[tuple], tuple | None]], schema: str, slots: int) -> DataFrame:
    """A streaming DataFrame of what ``advance(state or None, rows)`` gives out for each stream (its keys, in front of the columns that advance fills). Rows come
    without their keys, in the order of the other columns; a stream whose new state is None is forgotten."""
    columns = [*keys, *(c for c in rows.columns if c not in keys)]
    names = [part.split()[0] for part in schema.split(", ")]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept: dict[tuple, tuple] = pickle.loads(zlib.decompress(bytes(state.get[0]))) if state.exists else {}
        came: dict[tuple, list[tuple]] = {}
        for frame in frames:
            for row in zip(*(frame[c].tolist() for c in columns), strict=True):
                came.setdefault(row[: len(keys)], []).append(row[len(keys) :])
        out: list[tuple] = []
        for stream, own in came.items():
            given, after = advance(kept.pop(stream, None), own)
            out += [(*stream, *one) for one in given]
            if after is not None:
                kept[stream] = after
        if kept:
            state.update((zlib.compress(pickle.dumps(kept), 1),))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=names)

    slot = F.pmod(F.xxhash64(*keys), F.lit(slots)).alias("slot")
    return rows.select(slot, *columns).groupBy("slot").applyInPandasWithState(step, schema, _STATE, "append", GroupStateTimeout.NoTimeout)
