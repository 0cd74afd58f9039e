import json
import os
import random
import zlib

import pandas as pd
from pyspark.sql.streaming.stateful_processor import TimerValues

from pagelattice.streaming import queue


def simulate(rows, capacity, rate, remember):
    """Tick by tick: the worker takes, then names arrive."""
    out, pending, seen = [], [], {}
    rows = sorted(rows)
    for tick in range(rows[0][0], rows[-1][0] + 1):
        if tick > rows[0][0]:
            for name, since in pending[:rate]:
                out.append((name, "taken", since, tick))
            pending = pending[rate:]
        for t, name in rows:
            if t != tick or (name in seen and tick - seen[name] < remember):
                continue
            seen[name] = tick
            if len(pending) < capacity:
                pending.append((name, tick))
            else:
                out.append((name, "dropped", tick, None))
    return sorted(out, key=str)


def run(spark, folder, limits, files):
    """Each group of files arrives and is run to its end; the stream is stopped in between."""
    for k, group in enumerate(files):
        (folder / "in").mkdir(exist_ok=True)
        for at, rows in enumerate(group):
            path = folder / "in" / f"{k}-{at}.json"
            path.write_text("\n".join(json.dumps({"ts": f"2024-01-01T00:{t // 60:02d}:{t % 60:02d}Z", "domain": d}) for t, d in rows))
            os.utime(path, (1_700_000_000 + 10 * k + at,) * 2)
        source = spark.readStream.schema("ts timestamp, domain string").option("maxFilesPerTrigger", 1).json(str(folder / "in"))
        names = queue.bounded_queue(source, *limits)
        queue.run_queue(names, str(folder / "out"), str(folder / "state")).awaitTermination()
    found = spark.read.schema(queue.OUTCOME_SCHEMA).parquet(str(folder / "out"))
    return sorted(((r.domain, r.status, r.tick, r.taken_tick) for r in found.collect()), key=str), found


def test_restart_and_drops_against_a_simulation(spark, tmp_path):
    rnd = random.Random(3)
    rows = sorted((rnd.randrange(300), f"n{rnd.randrange(200):03d}") for _ in range(900))
    base = 1_704_067_200
    limits = (5, 1, 60)
    # Files end with whole ticks.
    ends = sorted({rows[300][0], rows[600][0]})
    parts = [[r for r in rows if r[0] < ends[0]], [r for r in rows if ends[0] <= r[0] < ends[-1]], [r for r in rows if r[0] >= ends[-1]]]
    cuts = [[parts[0]], [parts[1], parts[2]]]
    found, frame = run(spark, tmp_path, limits, cuts)
    want = simulate([(base + t, d) for t, d in rows], *limits)
    assert found == want
    assert {s for _, s, _, _ in found} == {"taken", "dropped"} and len({d for d, _, _, _ in found}) < len(found), "some names come again"
    counts = queue.drop_counts(frame).collect()
    assert sum(r.dropped for r in counts) == sum(s == "dropped" for _, s, _, _ in found)


def test_lanes_and_limits(spark, tmp_path):
    rows = [(0, f"n{k}") for k in range(30)] + [(9, "late")]
    names = spark.readStream.schema("ts timestamp, domain string").json(str(tmp_path))
    for bad in ({"capacity": 0}, {"rate": 0}, {"lanes": 0}):
        try:
            queue.bounded_queue(names, **bad)
        except ValueError:
            continue
        raise AssertionError("a limit below 1 is an error")
    found, _ = run(spark, tmp_path, (8, 2, 100, 1, 2), [[rows]])
    assert 30 - 8 <= sum(s == "dropped" for _, s, _, _ in found) <= 30 - 8 + 4
    state = queue.QueueState(2, 1, 10)
    assert list(state.advance(5)) == [] and state.arrive("a", 5) is None and state.arrive("b", 5) is None and state.arrive("c", 5) == ("c", "dropped", 5, None)
    assert list(state.advance(9)) == [("a", "taken", 5, 6), ("b", "taken", 5, 7)]


class Handle:
    """State of one key in memory, with the calls counted."""

    def __init__(self):
        self.values, self.timers, self.calls = {}, [], 0

    def getMapState(self, *_):
        return self

    def exists(self):
        self.calls += 1
        return bool(self.values)

    def containsKey(self, key):
        self.calls += 1
        return key in self.values

    def getValue(self, key):
        self.calls += 1
        return self.values[key]

    def updateValue(self, key, value):
        self.calls += 1
        self.values[key] = value

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.timers.append(at)


def part_of(handle, names, tick, watermark=0):
    processor = queue.FreshNames(5, 1, 100, 1, 0)
    processor.init(handle)
    rows = pd.DataFrame({"ts": pd.Timestamp(tick, unit="s"), "domain": names, "tick": tick, "piece": [zlib.crc32(n.encode()) % 4 for n in names]})
    out = pd.concat(processor.handleInputRows((0, 7), iter([rows[:10], rows[10:]]), TimerValues(-1, watermark)))
    return out[out["domain"].notna()], out[out["domain"].isna()]


def test_a_part_sends_the_lane_what_may_find_room():
    handle, names = Handle(), [f"n{k:04d}" for k in range(2000)]
    fresh, end = part_of(handle, names + names[:50], 10)
    assert sorted(fresh["domain"]) == names and fresh[fresh["part"] == queue.QUEUED]["domain"].tolist() == names[:5]
    assert set(fresh[fresh["part"] != queue.QUEUED]["part"]) == {7} and end[["part", "tick"]].values.tolist() == [[queue.QUEUED, 10]]
    assert handle.calls <= 1 + 4, "state is asked by pieces, not by names"
    fresh, end = part_of(handle, names, 60)
    assert fresh.empty and len(end) == 1, "all are remembered, and the clock goes on"
    fresh, _ = part_of(handle, ["n0001", "new"], 50, 110_000)
    assert fresh[["domain", "tick"]].values.tolist() == [["n0001", 110], ["new", 110]], "late names arrive now, and memory ends"


def test_parts_and_late_names_against_a_loop(spark, tmp_path):
    rnd = random.Random(5)
    draw = lambda low, high, n: sorted((rnd.randrange(low, high), f"n{rnd.randrange(150):03d}") for _ in range(n))
    first, second = draw(0, 60, 300), draw(40, 120, 300)
    found, _ = run(spark, tmp_path, (4, 1, 30, 1, 1, "10 minutes", 3), [[first, second]])
    base, clock = 1_704_067_200, first[-1][0]
    came = first + [(max(t, clock), d) for t, d in second]
    want, pending, seen, now = [], [], {}, came[0][0]
    for t, d in came:
        for now in range(now + 1, t + 1):
            if pending:
                name, since = pending.pop(0)
                want.append((name, "taken", base + since, base + now))
        now = t
        if d in seen and t - seen[d] < 30:
            continue
        seen[d] = t
        if len(pending) < 4:
            pending.append((d, t))
        else:
            want.append((d, "dropped", base + t, None))
    assert found == sorted(want, key=str)
