"""Stateful processors on many keys: what a task does for each stays small."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from tidemark.streaming import jobs


def test_pools_of_a_share_have_ends_of_their_own():
    ends = pd.DataFrame({"end_pool": [1, 1, 3, 3], "end_us": [10, 30, 20, 40], "end_arrival_us": [10, 30, 20, 40], "end_id": [1, 2, 3, 4], "end_price": 0})
    waiting = pd.DataFrame({"point_id": range(5), "pool": [1, 1, 2, 3, 3], "horizon": 5, "target_us": [10, 31, 10, 15, 41], "event_us": [5, 26, 5, 10, 36], "arrival_us": [5, 26, 5, 20, 36]})
    assert list(jobs.ForwardLabels(30)._first_ends(waiting, ends)) == [0, -1, -1, 3, -1]
    assert list(jobs.ForwardLabels(30)._first_ends(waiting, ends.iloc[:0])) == [-1] * 5
    rng = np.random.default_rng(3)
    ends = pd.DataFrame({"end_pool": rng.integers(0, 4, 60), "end_us": rng.integers(0, 200, 60), "end_id": range(60), "end_price": 0})
    ends = ends.assign(end_arrival_us=ends.end_us + rng.integers(0, 50, 60)).sort_values(["end_pool", "end_us", "end_arrival_us", "end_id"], ignore_index=True)
    waiting = pd.DataFrame({"pool": rng.integers(0, 6, 80), "event_us": rng.integers(0, 200, 80)})
    waiting = waiting.assign(target_us=waiting.event_us + 10, arrival_us=waiting.event_us + rng.integers(0, 50, 80))
    for w, found in zip(waiting.itertuples(), jobs.ForwardLabels(30)._first_ends(waiting, ends), strict=True):
        fit = ends[(ends.end_pool == w.pool) & (ends.end_us >= w.target_us) & (ends.end_us <= w.target_us + 30) & (ends.end_arrival_us > w.arrival_us)]
        assert found == (fit.index[0] if len(fit) else -1)


class Store:
    """A state handle of one key in memory that counts its calls."""

    def __init__(self):
        self.calls, self.kept = 0, {}

    def getValueState(self, name, schema):
        return State(self, name)

    getListState = getMapState = lambda self, name, *schema: State(self, name)


class State:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def __getattr__(self, call):
        self.store.calls += 1
        kept, name = self.store.kept, self.name
        return {
            "exists": lambda: name in kept, "clear": lambda: kept.pop(name, None), "update": lambda x: kept.update({name: x}), "put": lambda x: kept.update({name: list(x)}),
            "get": lambda: kept.get(name, []), "appendList": lambda x: kept.update({name: kept.get(name, []) + list(x)}),
        }[call]


def _decisions(n):
    return jobs.Decisions(10, 1000), pd.DataFrame({"observation_id": np.arange(n) // 2, "asset": np.arange(n) % 3, "expected": np.where(np.arange(n) % 7 < 4, 9, -9), "uncertainty": 1, "arrival_us": np.arange(n)})


def _lives(n):
    return jobs.Lifecycle(), pd.DataFrame({"action_id": np.arange(n) // 2, "action": np.where(np.arange(n) % 40 == 39, "remove", "open"), "delta": 5, "gas": 1, "failed": np.arange(n) % 17 == 0, "arrival_us": np.arange(n)})


@pytest.mark.parametrize("made", [_decisions, _lives])
def test_state_calls_do_not_grow_with_rows(made):
    processor, rows = made(400)
    processor.init(store := Store())
    whole = pd.concat(processor.handleInputRows((1,), iter([rows]), None), ignore_index=True)
    assert store.calls <= 8
    # In batches the same comes out: states carry over.
    processor, _ = made(1)
    processor.init(Store())
    parts = pd.concat([out for k in range(0, 400, 23) for out in processor.handleInputRows((1,), iter([rows[k : k + 23]]), None)], ignore_index=True)
    pd.testing.assert_frame_equal(whole, parts)
