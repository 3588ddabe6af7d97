"""Keyed folds that run alike over a finished table and over a stream.

A fold is a pure ``step(state, row) -> rows`` that changes a plain dict. ``replay`` applies it to each
key's rows in order; ``stream`` keeps the dict as JSON in the state store and applies the same step to
each micro-batch. Rows of a key are streamed through in Arrow batches, so only the dict is held.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Step = Callable[[dict, dict], list[dict]]
_END = "_end"


def _plain(row: dict) -> dict:
    """A row with missing values as None."""
    return {k: (None if not isinstance(v, (list, dict)) and pd.isna(v) else v) for k, v in row.items()}


def _rows(found: list[dict], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(found, columns=names).astype(object)


def replay(rows: DataFrame, key: str, order: str, step: Step, schema: str, finish: bool = True) -> DataFrame:
    """The fold over each key's rows in order; with ``finish`` a last step sees ``{"_end": True}``."""
    names = [c.split()[0] for c in schema.split(", ")]
    dealt = rows.repartition(key).sortWithinPartitions(key, order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, {}
        for batch in batches:
            out: list[dict] = []
            for row in map(_plain, batch.to_dict("records")):
                if row[key] != now:
                    if now is not None and finish:
                        out += step(state, {key: now, _END: True})
                    now, state = row[key], {}
                out += step(state, row)
            yield _rows(out, names)
        if now is not None and finish:
            yield _rows(step(state, {key: now, _END: True}), names)

    return dealt.mapInPandas(run, schema)


def stream(rows: DataFrame, key: str, order: str, step: Step, schema: str) -> DataFrame:
    """The fold over a stream; each key's rows of a micro-batch are put in order first."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(held.get[0]) if held.exists else {}
        whole = pd.concat(list(batches)).sort_values(order, kind="stable")
        out = [x for row in map(_plain, whole.to_dict("records")) for x in step(state, row)]
        held.update((json.dumps(state, sort_keys=True),))
        yield _rows(out, names)

    return rows.groupBy(key).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.NoTimeout)
