"""Calls of the state that a key costs, each a round trip."""

import pandas as pd

from flowspark.streaming.processors import _RetryTimers, _Transactions


class _State:
    """A state that counts its calls."""

    def __init__(self):
        self.calls, self.rows = [], []

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name == "appendList":
                self.rows += args[0]
            return {"exists": bool(self.rows), "get": iter(self.rows), "listTimers": iter([]), "getCurrentProcessingTimeInMs": 0}.get(name)
        return call


def _rows(*lsns, last):
    return pd.DataFrame({"txid": [7] * len(lsns), "lsn": lsns, "row": ["I"] * len(lsns), "is_last": [n in last for n in lsns]})


def test_whole_transactions_need_no_state():
    whole, parts = _Transactions(1000), _Transactions(1000)
    for one in (whole, parts):
        one.handle = one.held = _State()
    found = pd.concat(whole.handleInputRows((7,), iter([_rows(1, 2, last=[2])]), _State()))
    assert found.to_dict("list") == {"txid": [7, 7], "lsn": [1, 2], "row": ["I", "I"], "complete": [True, True]}
    assert whole.held.calls == ["exists"]
    assert list(parts.handleInputRows((7,), iter([_rows(1, last=[])]), _State())) == []
    found = pd.concat(parts.handleInputRows((7,), iter([_rows(2, last=[]), _rows(3, last=[3])]), _State()))
    assert found["lsn"].tolist() == [1, 2, 3] and found["complete"].all()


def test_waiting_messages_cost_two_calls():
    timers = _RetryTimers(3, 50, 1000)
    timers.handle = timers.waiting = _State()
    assert list(timers.handleInputRows(("m",), iter([pd.DataFrame({"attempts": [1]})]), _State())) == []
    assert timers.waiting.calls == ["update", "registerTimer"]
