"""Calls of keyed state to its store do not grow with the rows of a key."""

import json
from types import SimpleNamespace

from pyspark.sql import Row

from hushframe.streaming import state


class Store:
    """A state variable and the timers of one key, which count how often they are asked."""

    def __init__(self):
        self.calls, self.value, self.fields, self.timers = 0, None, {}, []

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name == "get":
                return self.value
            if name == "update":
                self.value = args[0]
            elif name == "exists":
                return bool(self.fields)
            elif name == "iterator":
                return iter(list(self.fields.items()))
            elif name == "updateValue":
                self.fields[args[0]] = args[1]
            elif name == "removeKey":
                del self.fields[args[0]]
            elif name == "clear":
                self.value, self.fields = None, {}
            elif name == "listTimers":
                return iter(self.timers)
            elif name == "registerTimer":
                self.timers.append(args[0])
            elif name == "deleteTimer":
                self.timers.remove(args[0])

        return (lambda *_: self) if name in ("getValueState", "getMapState") else call


NOW = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)


def test_a_run_of_many_patches_reads_and_writes_its_fields_once():
    store, runs = Store(), state.Runs()
    runs.init(store)
    patches = ['{"kind":"start"}', *[json.dumps({"stage": f"s{k}"}) for k in range(500)], "[1"]
    out = list(runs.handleInputRows((1,), iter([Row(run_id=1, seq=k, us=k, patch=p) for k, p in enumerate(patches)]), NOW))
    assert [r.kind for r in out] == ["refused", "state"] and json.loads(out[1].state) == {"active": True, "stopRequested": False, "stage": "s499"}
    assert store.calls <= 6
    list(runs.handleInputRows((1,), iter([Row(run_id=1, seq=600, us=600, patch='{"kind":"start"}')]), NOW))
    assert set(store.fields) == {("active",), ("stopRequested",)} and len(store.timers) == 1


def test_a_token_asks_only_for_what_changes():
    store, tokens = Store(), state.Tokens()
    tokens.init(store)

    def rows(*kinds):
        return iter([Row(page_id=1, token="a", us=1000 * t, kind=k, frame_id=7) for t, k in kinds])

    assert [r.reason for r in tokens.handleInputRows((1, "a"), rows((0, "announce"), (1, "ack"), (2, "detach")), NOW)] == ["detached"]
    assert store.calls == 1 and not store.timers
    list(tokens.handleInputRows((1, "a"), rows((3, "announce"), (4, "announce")), NOW))
    assert store.calls == 4 and store.timers == [3 + state.ANNOUNCED_MS]
    assert [r.frame_id for r in tokens.handleInputRows((1, "a"), rows((5, "ack"), (6, "report")), NOW)] == [7]
    assert store.calls == 6 and store.timers == [3 + state.ANNOUNCED_MS]
