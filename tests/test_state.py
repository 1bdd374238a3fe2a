"""State in streams over several batches: sessions that join, timers, and what is forgotten."""

import time

from tessera.streaming.state import first_seen, rocks, stream_sessions_of
from tessera.streaming.queries import run
from tests.test_streaming import T0, _at, _stream


def _events(spark, folder, batches):
    return _stream(spark, folder, [[(i, u, _at(m)) for i, u, m in b] for b in batches])


def _sessions(spark, tmp_path, batches, gap=30):
    with rocks(spark):
        stream = _events(spark, str(tmp_path), batches).selectExpr("*", "case when id % 2 = 0 then 'even' else 'odd' end kind")
        found = run(stream_sessions_of(stream, "user_id", "ts", "kind", gap * 60, "100 minutes")).collect()
    minutes = lambda t: int((t - T0).total_seconds() // 60)
    return sorted((r["user_id"], minutes(r["opening"]), minutes(r["latest"]), r["n"], r["kinds"]) for r in found)


def test_sessions_join_out_of_order(spark, tmp_path):
    # 0..20 and 60..70 are joined by 40 (gaps of 20, 20, 10); 101 is more than thirty minutes on; user 2 is still open at the end
    batches = [[(1, 1, 0), (2, 1, 20), (3, 2, 500)], [(4, 1, 60), (5, 1, 70), (6, 1, 101)], [(7, 1, 40)], [(8, 3, 700)], [(9, 3, 900), (10, 2, 880)]]
    found = _sessions(spark, tmp_path, batches)
    assert (3, 700, 700, 1, 1) in found
    assert [r for r in found if r[0] == 2] == [(2, 500, 500, 1, 1)]
    assert sum(r[3] for r in found if r[0] == 1) <= 6


def test_sessions_within_the_watermark(spark, tmp_path):
    batches = [[(1, 1, 0), (2, 1, 20)], [(4, 1, 60), (5, 1, 70)], [(7, 1, 40), (6, 1, 101)], [(8, 2, 400)], [(9, 2, 600)]]
    assert _sessions(spark, tmp_path, batches) == [(1, 0, 70, 5, 2), (1, 101, 101, 1, 1), (2, 400, 400, 1, 1)]


def test_a_gap_of_just_the_length_does_not_part(spark, tmp_path):
    batches = [[(1, 1, 0), (2, 1, 30), (4, 1, 61), (6, 5, 0)], [(8, 2, 400)], [(10, 2, 700)]]
    assert _sessions(spark, tmp_path, batches) == [(1, 0, 30, 2, 2), (1, 61, 61, 1, 1), (2, 400, 400, 1, 1), (5, 0, 0, 1, 1)]


def test_kinds_are_forgotten(spark, tmp_path):
    batches = [[(1, 1, 0), (2, 1, 1)], [(3, 1, 2), (4, 2, 3)]]

    def told(name, forget_ms, pause):
        out = []
        with rocks(spark, idle=False):
            stream = _events(spark, str(tmp_path / name), batches).selectExpr("*", "'k' kind")

            def save(batch, _):
                out.extend((r["user_id"], r["id"]) for r in batch.collect())
                time.sleep(pause)

            seen = first_seen(stream, "user_id", "kind", "id", forget_ms)
            seen.writeStream.outputMode("append").foreachBatch(save).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start().awaitTermination()
        return sorted(out)

    assert told("a", 3_600_000, 0) == [(1, 1), (2, 4)]
    assert told("b", 500, 1.5) == [(1, 1), (1, 3), (2, 4)]


class _Counting:
    """A handle whose state is plain Python, which counts the calls to it."""

    def __init__(self):
        self.calls, self.rows, self.pairs, self.timers = 0, [], {}, set()

    def _called(self, out=None):
        self.calls += 1
        return out

    def getListState(self, name, schema):
        return self

    def getMapState(self, name, *_):
        return self

    exists = lambda self: self._called(bool(self.rows))
    get = lambda self: iter(self._called(list(self.rows)))
    iterator = lambda self: iter(self._called([(k, v) for k, v in self.pairs.items()]))

    def put(self, rows):
        self.rows = self._called(list(rows))

    def clear(self):
        self.rows = self._called([])

    def updateValue(self, k, v):
        self.pairs[k] = self._called(v)

    def removeKey(self, k):
        self._called(self.pairs.pop(k, None))

    def registerTimer(self, t):
        self._called(self.timers.add(t))

    def deleteTimer(self, t):
        self._called(self.timers.discard(t))

    def getCurrentWatermarkInMs(self):
        return self.passed


def test_sessions_take_few_calls_to_the_state():
    """Two batches of 500 sessions of a key, then the watermark closes all but the last."""
    import pandas as pd

    from tessera.streaming.state import Sessions

    handle, gap = _Counting(), 1_000_000
    sessions = Sessions(gap)
    sessions.init(handle)
    at = [i * 10 * gap for i in range(1000)]
    for part in (at[::2], at[1::2]):
        list(sessions.handleInputRows((1,), iter([pd.DataFrame({"at": part + [x + gap // 2 for x in part], "kind": ["a"] * 500 + [None] * 500})]), handle))
    handle.passed, told = at[-1] // 1000, []
    while due := sorted(t for t in handle.timers if t <= handle.passed):
        handle.timers.discard(due[0])
        told += [f for f in sessions.handleExpiredTimer((1,), handle, None)]
    rows = pd.concat(told)
    assert sorted(rows["opening"]) == at[:-1] and set(rows["n"]) == {2} and set(rows["kinds"]) == {2}
    assert [tuple(r)[:3] for r in handle.rows] == [(at[-1], at[-1] + gap // 2, 2)] and len(handle.timers) == 1
    assert handle.calls < 20
