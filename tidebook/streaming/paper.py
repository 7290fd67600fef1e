"""The paper book: the fold of the simulation over keyed state, one batch of sessions at a time."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.money import Costs
from ..operators.book import Replay
from ..operators.simulation import EVENTS, as_batch


def paper_book(sessions: DataFrame, first: int, risk: dict[str, Any], costs: Costs | None = None, capital: float = 100_000.0) -> DataFrame:
    """Events of each book of a stream of candidate rows. A batch holds whole sessions; sessions already settled are passed over.

    Nothing is closed by force at an end, as a live book has none; else the events are those of a batch run.
    """
    costs = costs or Costs()

    def settle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        replay = Replay(risk, costs, capital, first)
        if state.exists:
            replay.load(state.get[0])
        frame = pd.concat(list(frames)).sort_values(["session", "id"])
        frame = frame[frame["session"] >= replay.at]
        rows = frame.astype(object).where(frame.notna(), None).to_dict("records")
        out = [e for row in rows for e in replay.feed(_plain(row))]
        if rows:
            out += replay.before(int(rows[-1]["session"]) + 1)
        state.update((replay.dump(),))
        yield as_batch([{"run_id": key[0]} | e for e in out]).to_pandas()

    return sessions.groupBy("run_id").applyInPandasWithState(settle, EVENTS, "state string", "append", GroupStateTimeout.NoTimeout)


def _plain(row: dict) -> dict:
    acts = row.get("actions")
    row["actions"] = [{"kind": a["kind"], "value": float(a["value"])} for a in acts] if acts is not None else None
    return {k: (v.item() if hasattr(v, "item") else v) for k, v in row.items()}
