"""The stream of moving ranges against a plain version, over restarts and by size of its state."""

import datetime as dt
import random

import pandas as pd

from tabsmith.streaming import quality

START = dt.datetime(2024, 1, 1)
SCHEMA = "k string, ts timestamp, id long, v double"


def write_batches(spark, folder, batches, first=0):
    """One file a batch; the file stream reads them by time of change, so names and times agree."""
    import os

    for i, rows in enumerate(batches, first):
        path = f"{folder}/b{i:03d}.parquet"
        frame = pd.DataFrame(rows, columns=["k", "ts", "id", "v"])
        frame["ts"] = frame["ts"].astype("datetime64[us]").dt.tz_localize("UTC")
        frame.to_parquet(path, coerce_timestamps="us")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))


def plain(rows, mark):
    out, last = {}, {}
    for k, ts, i, v in sorted((r for r in rows if r[1] is not None), key=lambda r: (str(r[0]), r[1], r[2])):
        if ts > mark:
            continue
        before = last.get(k, None)
        out[i] = None if before is None or v is None else round(abs(v - before), 9)
        last[k] = v
    return out


def stream(spark, folder):
    src = quality.read_files(spark, str(folder), "*.parquet", SCHEMA, per_trigger=1)
    return quality.moving_range(src, "k", "ts", "id", "v", "4 minutes")


def jittered(n, seed, start=0):
    """Rows a second apart over three keys, one of them with most rows, up to 100 seconds out of order."""
    rng = random.Random(seed)
    rows = [
        (rng.choice(["hot"] * 6 + ["cold", None]), START + dt.timedelta(seconds=start + i), start + i,
         None if i % 37 == 5 else float(rng.randrange(1000)))
        for i in range(n)
    ]
    return sorted(rows, key=lambda r: r[1] + dt.timedelta(seconds=rng.randrange(100)))


def results(done):
    return {r["id"]: None if r["mr"] is None else round(r["mr"], 9) for r in done.collect()}


def test_moving_range_goes_on_after_a_restart(spark, tmp_path):
    folder, kept = tmp_path / "in", tmp_path / "run"
    folder.mkdir()
    rows = jittered(1200, 3)
    batches = [rows[i : i + 200] for i in range(0, 1200, 200)]
    write_batches(spark, folder, batches[:3])
    first = results(quality.run_to_end(stream(spark, folder), "append", folder=str(kept)))
    assert first == plain(rows[:600], max(r[1] for r in rows[:600]) - dt.timedelta(minutes=4))
    write_batches(spark, folder, batches[3:], 3)
    done = quality.run_to_end(stream(spark, folder), "append", folder=str(kept))
    assert results(done) == plain(rows, max(r[1] for r in rows) - dt.timedelta(minutes=4))
    assert done.count() == len(results(done)), "no row is given twice"


def test_moving_range_drops_and_counts_late_rows_and_leaves_out_rows_without_a_time(spark, tmp_path):
    rows = jittered(900, 5)
    late = [("hot", START + dt.timedelta(seconds=3), 5000, 1.0), ("hot", None, 5001, 1.0)]
    batches = [rows[:300], rows[300:600], rows[600:] + late]
    write_batches(spark, tmp_path, batches)
    done = quality.run_to_end(stream(spark, tmp_path), "append")
    assert results(done) == plain(rows, max(r[1] for r in rows) - dt.timedelta(minutes=4))


def test_moving_range_state_stays_flat_behind_the_watermark(spark, tmp_path):
    folder, sizes = tmp_path / "in", []
    folder.mkdir()
    for part in range(3):  # each part is ten minutes on, in files of its own
        write_batches(spark, folder, [jittered(600, part, part * 600)], part)
        quality.run_to_end(stream(spark, folder), "append", folder=str(tmp_path / "run"))
        version = [int(p.name) for p in (tmp_path / "run/state/commits").iterdir() if p.name.isdigit()]
        sizes.append(pending(spark, tmp_path / "run/state", max(version)))
    assert max(sizes) <= 4 * 60 + 100 and sizes[2] <= 1.3 * sizes[0]


def pending(spark, state, batch):
    """Rows in the lists, by the reader of state stores."""
    total = 0
    for i in range(quality.RING):
        read = spark.read.format("statestore").option("stateVarName", f"slot{i}").option("batchId", batch)
        total += read.load(str(state)).count()
    return total


class Kept:
    """A state variable of one key, in memory."""

    def __init__(self):
        self.rows = None

    def exists(self):
        return self.rows is not None

    def get(self):
        return iter(self.rows) if isinstance(self.rows, list) else self.rows

    def update(self, row):
        self.rows = row

    def clear(self):
        self.rows = None

    def appendList(self, rows):
        self.rows = [*(self.rows or []), *rows]


class Handle:
    def __init__(self):
        self.timers = []

    def getValueState(self, name, schema):
        return Kept()

    getListState = getValueState

    def registerTimer(self, ms):
        self.timers.append(ms)


class Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_moving_range_gives_out_many_rows_in_parts(monkeypatch):
    monkeypatch.setattr(quality, "RELEASED", 70, raising=False)
    job, handle = quality.MovingRange(1_000_000), Handle()
    job.init(handle)
    rng = random.Random(8)
    rows = [(rng.randrange(1, 401) * 100_000, None if i % 50 == 7 else i, None if i % 11 == 3 else rng.random()) for i in range(1000)]
    pdf = pd.DataFrame(rows, columns=["at", "id", "value"]).assign(ts=lambda d: pd.to_datetime(d["at"], unit="us"))
    assert not list(job.handleInputRows(("k",), iter([pdf]), Mark(0)))
    assert handle.timers
    parts = [p for ms in (25_000, 60_000) for p in job.handleExpiredTimer(("k",), Mark(ms), None)]
    assert max(map(len, parts)) <= 70, "a key's rows are never one frame"
    got = pd.concat(parts).astype(object).where(lambda d: d.notna(), None)
    want, last = [], None
    for at, i, v in sorted(rows, key=lambda r: tuple((x is not None, x) for x in r)):
        want.append((pd.Timestamp(at, unit="us"), i, v, None if last is None or v is None else abs(v - last)))
        last = v
    assert list(got[["ts", "id", "value", "mr"]].itertuples(index=False, name=None)) == want
    assert all(not k.exists() for k in job.lists)
