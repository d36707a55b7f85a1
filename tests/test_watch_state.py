"""Calls for state of stream_watch: they cost far more than readings do, so they must not grow with an asset's readings."""

from collections import Counter

import pandas as pd
from pyspark.sql import types as T

from millwright.streaming import streams


class Held:
    """State of one asset in memory; counts calls and items."""

    def __init__(self):
        self.calls, self.lists, self.value, self.timers = Counter(), {}, None, set()

    def getListState(self, name, schema):  # noqa: N802
        held = self.lists.setdefault(name, [])
        owner = self

        class State:
            def exists(self):
                owner.calls["exists"] += 1
                return bool(held)

            def get(self):
                owner.calls["get"] += 1
                owner.calls["items read"] += len(held)
                return iter(list(held))

            def appendValue(self, item):  # noqa: N802
                self.appendList([item])

            def appendList(self, items):  # noqa: N802
                owner.calls["append"] += 1
                owner.calls["items written"] += len(items)
                held.extend(items)

            def put(self, items):
                self.clear()
                self.appendList(items)

            def clear(self):
                held.clear()

        return State()

    def getValueState(self, name, schema):  # noqa: N802
        owner = self

        class State:
            def exists(self):
                return owner.value is not None

            def get(self):
                return owner.value

            def update(self, value):
                owner.value = value

            def clear(self):
                owner.value = None

        return State()

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)

    def listTimers(self):  # noqa: N802
        self.calls["list timers"] += 1
        return iter(sorted(self.timers))


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms


def test_calls_do_not_grow_with_readings_and_one_timer_is_kept():
    held, told = Held(), []
    watch = streams._Watch(T.LongType(), 3, 86_400_000_000, 2 * 86_400_000_000, 60 * 86_400_000_000)
    watch.init(held)
    second, n = 1_000_000, 3000
    rows = [("a", t * second, t, "on" if t % 1000 else None) for t in range(5000, 5000 + n)]
    for part in (rows[2000:], rows[1000:2000], rows[:1000]):  # the latest first: the timer moves
        told += watch.handleInputRows(("a",), iter([pd.DataFrame(part, columns=["asset", "at", "key", "state"])]), Now(0))
        assert held.timers == {part[0][1] // 1000}
    assert held.calls["items written"] == 3 and not held.calls["items read"] and not held.calls["list timers"]
    held.timers.clear()
    told += watch.handleExpiredTimer(("a",), Now(6_500_000), None)  # half of them are due
    assert held.timers == {6_501_000} and held.calls["items read"] == 3 and held.calls["items written"] == 4
    late = pd.DataFrame([("a", 6_500_500 * 1000, 1, "off")], columns=["asset", "at", "key", "state"])
    told += watch.handleInputRows(("a",), iter([late]), Now(6_500_000))
    assert held.timers == {6_500_500} and held.calls["items read"] == 3
    held.timers.clear()
    told += watch.handleExpiredTimer(("a",), Now(10**10), None)
    out = pd.concat(told)
    assert out["kind"].tolist() == ["flatline", "flatline", "flatline", "silent", "flatline"]  # the open run is told last
    assert out["n"].dropna().tolist() == [999, 500, 499, 999]
    assert not held.timers and held.value is None and not held.lists["buffer"]
