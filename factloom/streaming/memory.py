"""The count trigger as a stateful stream: one mark per session, safe to restart from its checkpoint.

State per session is two numbers. Messages of a session arrive in any number of micro-batches; a trigger fires when the
count since the mark reaches the threshold. Messages that arrive together while a session is handled are coalesced:
at most `max_runs` extractions a micro-batch, the last of them over all that is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "conv_id long, latest_count long, new_messages long"


def message_triggers(messages: DataFrame, session: str = "conv_id", min_new: int = 4, max_runs: int = 10) -> DataFrame:
    """(conv_id, latest_count, new_messages) whenever `min_new` messages have come since the session's mark."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, mark = state.get if state.exists else (0, 0)
        count += sum(len(b) for b in batches)
        rows = []
        while count - mark >= min_new and len(rows) < max_runs:
            new = min_new if len(rows) < max_runs - 1 else count - mark
            mark += new
            rows.append((key[0], mark, new))
        state.update((count, mark))
        yield pd.DataFrame(rows, columns=["conv_id", "latest_count", "new_messages"]).astype("int64")

    return messages.groupBy(session).applyInPandasWithState(step, OUTPUT, "count long, mark long", "append", GroupStateTimeout.NoTimeout)
