"""Profiles of masks while the blocks of volumes arrive, in any order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from planewise.functions.columns import KEYS
from planewise.functions.constants import AREA_FLOOR, SLIVER_FRAC
from planewise.operators.profile import profiles


def _packed(areas: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(areas, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _opened(held: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(held).read_all().to_pandas()


def complete_volumes(areas: DataFrame, keys: tuple[str, ...] = KEYS, late: str = "1 hour") -> DataFrame:
    """The plane areas of a stream, a volume at a time: ``label``, ``z``, ``area`` and ``complete``.

    Input rows are counts of a label, background included, in some block of a plane, with the ``n_voxels`` of the whole volume and
    the time ``ts`` at which the block was made; blocks come in any order.  The state of a volume is its areas so far, added up, a few
    bytes for each label and plane.  It is given out when all voxels are counted, or, not ``complete``, when the
    watermark is ``late`` past its last block.  What comes after that is left out.
    """

    def step(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, counted, done = state.get if state.exists else (b"", 0, False)
        if state.hasTimedOut:
            if not done:
                state.update((b"", counted, True))
                yield _given(key, _opened(held), False)
            return
        rows = pd.concat([p for p in parts])
        if done:
            return
        both = [rows[["label", "z", "area"]], *([_opened(held)] if held else [])]
        own = pd.concat(both).groupby(["label", "z"], as_index=False)["area"].sum()
        counted += int(rows["area"].sum())
        if counted >= int(rows["n_voxels"].max()):
            state.update((b"", counted, True))
            yield _given(key, own, True)
            return
        state.update((_packed(own), counted, False))
        state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs() + 1))

    def _given(key: tuple[Any, ...], own: pd.DataFrame, complete: bool) -> pd.DataFrame:
        return own.assign(**dict(zip(keys, key, strict=True)), complete=complete)[[*keys, "label", "z", "area", "complete"]]

    timed = areas.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    kinds = ", ".join(f"{k} string" for k in keys)
    out = f"{kinds}, label long, z long, area long, complete boolean"
    return timed.groupBy(*keys).applyInPandasWithState(step, out, "held binary, counted long, done boolean", "append", GroupStateTimeout.EventTimeTimeout)


def profile_stream(areas: DataFrame, give: Callable[[DataFrame, int], None], area_floor: float = AREA_FLOOR, sliver_frac: float = SLIVER_FRAC, keys: tuple[str, ...] = KEYS, late: str = "1 hour") -> DataStreamWriter:
    """A stream that hands jitter and sway of all masks of a volume to ``give``, with the batch's number, once the volume is given out.

    All planes of a mask come in one batch, so its profile is that of the whole table.
    """

    def batch(whole: DataFrame, number: int) -> None:
        give(profiles(whole.where("label > 0").drop("complete"), area_floor, sliver_frac, keys), number)

    return complete_volumes(areas, keys, late).writeStream.outputMode("append").foreachBatch(batch)
