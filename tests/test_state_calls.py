"""How often a key asks the state store: each call goes through a socket."""

from __future__ import annotations

from pyspark.sql import Row

from talkloom.streaming import recording


class Handle:
    """One state for every name; counts what it is asked."""

    def __init__(self):
        self.calls = []

    def getValueState(self, name, schema):  # noqa: N802  named by Spark
        return self

    getListState = getValueState

    def __getattr__(self, call):
        return lambda *a: self.calls.append(call)


def test_a_first_sound_takes_four_calls_a_key():
    handle = Handle()
    processor = recording._FirstSound(16, 0, None)
    processor.init(handle)
    out = list(processor.handleInputRows((1, "mic"), iter([Row(label="mic", frame_ix=k, samples=[0.5, 0.5]) for k in range(3)]), None))
    assert [tuple(r) for r in out] == [(1, "mic", 4 / 16)]
    assert sorted(handle.calls) == ["get", "get", "update", "update"]  # nothing waits, so no list is read
