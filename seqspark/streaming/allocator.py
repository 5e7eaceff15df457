"""Streaming allocation: the replay's state machine with its state kept per key by Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, fields

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from seqspark.config import AllocatorConfig
from seqspark.operators.replay import KeyState

STATE = ", ".join(f"{f.name} bigint" for f in fields(KeyState))
OUT = "sequence_key string, tie bigint, id bigint, watermark bigint"


def allocate_stream(requests: DataFrame, config: AllocatorConfig) -> DataFrame:
    """sequence_key, tie, id, watermark for a stream of (sequence_key, ts, tie); append mode.

    Requests of a key in one batch are taken by (ts, tie), batches as they arrive. The state checkpoint is the watermark:
    a restart goes on behind it. Idle eviction is decided when a key's next request comes, which gives the same ids as
    evicting at the timeout; a watermark must outlive its key's ranges, so that no state is dropped.
    """

    def serve(key: tuple, pages: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = KeyState(*state.get) if state.exists else KeyState()
        rows = pd.concat(list(pages)).sort_values(["at", "tie"], kind="stable")
        out = []
        for at, tie in zip(rows["at"], rows["tie"], strict=True):
            out.append((key[0], int(tie), held.allocate(int(at), config), held.watermark))
        state.update(tuple(int(x) for x in astuple(held)))
        yield pd.DataFrame(out, columns=["sequence_key", "tie", "id", "watermark"])

    rows = requests.select("sequence_key", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("tie").cast("long").alias("tie"))
    return rows.groupBy("sequence_key").applyInPandasWithState(serve, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
