"""Array kernels that run inside Python workers. They know numpy and Arrow, not Spark."""

from __future__ import annotations

import pickle
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle

# Ship the kernels with the job: workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SECOND = 1_000_000
ACCEPTED, SHED = "accepted", "shed"
NEVER = -(2**63)
HELPERS = ("_head", "_us", "_cost", "_rate", "_level", "_since", "_part", "_key", "_tie", "_run", "_path", "_end_level", "_end_us")
#: Rows between two checkpoints of a path.
STEP = 4096


def admit(us: np.ndarray, cost: np.ndarray, level: int, since: int | None, rate: int) -> tuple[np.ndarray, int]:
    """Token bucket over ordered rows: which are accepted, and the credit left at the last one.

    Credit counts whole bytes and refills on the absolute clock, floor(rate * t), so no rounding
    depends on where a run starts. The cap is one second of rate. A row older than `since` counts as
    arriving then. While nothing is shed, credit is a
    cumulative sum held under a ceiling, so such stretches are decided with whole-array operations;
    only the rows around a shed one are stepped through.
    """
    # Two seconds before the first row credit is full either way. Counting from there keeps the clock small.
    since = int(us[0]) if since is None else max(since, int(us[0]) - 2 * SECOND)
    base = since // SECOND
    clock = (us // SECOND - base) * rate + (us % SECOND) * rate // SECOND
    at = (since % SECOND) * rate // SECOND
    clock = np.maximum(clock, at)
    ok = np.ones(len(us), dtype=bool)
    i = 0
    while i < len(us):
        spent = np.concatenate(([0], np.cumsum(cost[i:])[:-1]))
        free = level + (clock[i:] - at) - spent
        before = free - np.maximum.accumulate(np.maximum(free - rate, 0))
        short = np.flatnonzero(before < cost[i:])
        if not len(short):
            return ok, int(before[-1] - cost[-1])
        k = i + int(short[0])
        level, at, ok[k] = int(before[k - i]), int(clock[k]), False
        # Shed rows come in runs: step through a stretch before trying a whole one again.
        i, stop = k + 1, min(len(us), k + 257)
        while i < stop:
            now, want = int(clock[i]), int(cost[i])
            level, at = min(rate, level + now - at), now
            if want <= level:
                level -= want
            else:
                ok[i] = False
            i += 1
    return ok, level


def bucket_kernel(state: list[str], tag: bool, step: int = STEP):
    """Arrow kernel over rows sorted by (state, _head first, time).

    Every stretch opens with a head row: its rate, and the credit it starts with (null: what the stretch
    before left). The kernel streams batches, so memory does not depend on the length of a run. It emits
    either the tagged rows or, per stretch, the credit it started and ended with and the credit after
    every `step` rows (`_path`: level and time by turns). A head row may bring the path and end of an
    earlier run: where the credit meets that path, the rest of the stretch would repeat, so the known
    end is taken and no further row is looked at. A rate of 0 is no limit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, rate, level, since = None, 0, 0, None
        begin, path, known, seen = (0, NEVER), [], None, 0

        def spot() -> tuple[int, int]:
            return level, NEVER if since is None else since

        def close() -> pa.RecordBatch:
            numbers = [pa.array([n], pa.int64()) for n in (*begin, *spot())]
            return pa.RecordBatch.from_arrays([*name, *numbers, pa.array([path], pa.list_(pa.int64()))], names=[*state, "_level", "_since", "_end_level", "_end_us", "_path"])

        for batch in batches:
            if not batch.num_rows:
                continue
            head, us, cost = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_head", "_us", "_cost"))
            tags = np.ones(len(head), dtype=bool)
            cuts = np.unique(np.concatenate(([0], np.flatnonzero(head == 1), [len(head)])))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if head[a] == 1:
                    if name is not None and not tag:
                        yield close()
                    first = {c: batch.column(c)[a].as_py() for c in ("_rate", "_level", "_since", "_path", "_end_level", "_end_us")}
                    if first["_level"] is not None:
                        level, since = first["_level"], None if first["_since"] == NEVER else first["_since"]
                    name, rate, begin, path, seen = [batch.column(c).slice(a, 1) for c in state], first["_rate"], spot(), [], 0
                    known = None if first["_path"] is None else (first["_path"], first["_end_level"], first["_end_us"])
                    a += 1
                while a < b and rate:
                    stop = b if tag else min(b, a + step - seen % step)
                    tags[a:stop], level = admit(us[a:stop], cost[a:stop], level, since, rate)
                    since = int(us[stop - 1]) if since is None else max(since, int(us[stop - 1]))
                    seen, a = seen + stop - a, stop
                    if seen % step or tag:
                        continue
                    path.extend(spot())
                    if known and tuple(known[0][len(path) - 2 : len(path)]) == spot():
                        path, level, since, rate = path + known[0][len(path) :], *known[1:], 0
                        since = None if since == NEVER else since
            if tag:
                rows = np.flatnonzero(head == 0)
                verdict = pa.array(np.where(tags[rows], ACCEPTED, SHED), pa.string())
                kept = batch.select([c for c in batch.schema.names if c not in HELPERS]).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*kept.columns, verdict], names=[*kept.schema.names, "verdict"])
        if name is not None and not tag:
            yield close()

    return run


def rate_state(rate: int, order: list[str], columns: list[str], step: int = 1 << 20):
    """Grouped state function: the token bucket of one key, one micro-batch at a time.

    What is sorted are numbers only. The rows wait packed, frame by frame, and come out in the order they came
    in; credit is worked out `step` rows at a time.
    """

    def run(_key, frames, state):
        numbers, packed = [], []
        for frame in frames:
            numbers.append(frame[["_us", *order, "_cost"]].copy())
            packed.append(zlib.compress(pickle.dumps(frame[columns]), 1))
        sizes = [len(x) for x in numbers]
        rows = pd.concat(numbers, ignore_index=True)
        numbers.clear()
        rows = rows.sort_values(["_us", *order])
        us, cost, place = rows["_us"].to_numpy(), rows["_cost"].to_numpy(), rows.index.to_numpy()
        del rows
        level, since = state.get if state.exists else (rate, None)
        ok = np.empty(len(us), dtype=bool)
        for a in range(0, len(us), step):
            b = min(a + step, len(us))
            ok[place[a:b]], level = admit(us[a:b], cost[a:b], int(level), since, rate)
            since = int(us[b - 1]) if since is None else max(since, int(us[b - 1]))
        state.update((level, since))
        del us, cost, place
        at = 0
        for i, n in enumerate(sizes):
            frame, packed[i] = pickle.loads(zlib.decompress(packed[i])), None
            yield frame.assign(verdict=np.where(ok[at : at + n], ACCEPTED, SHED))
            at += n

    return run


def in_flight_state(cap: int, order: list[str], columns: list[str]):
    """Grouped state function: bytes offered since the last flush of one key."""

    def run(_key, frames, state):
        rows = pd.concat(list(frames)).sort_values(["_us", *order])
        epoch, used = state.get if state.exists else (None, 0)
        total = rows.groupby("_epoch")["_cost"].cumsum()
        total = total + np.where(rows["_epoch"] == epoch, used, 0)
        state.update((int(rows["_epoch"].iloc[-1]), int(total.iloc[-1])))
        yield rows[columns].assign(verdict=np.where(total <= cap, ACCEPTED, SHED))

    return run
