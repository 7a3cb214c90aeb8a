"""What the deduplication of a stream holds."""

import numpy as np
import pandas as pd
import pyarrow as pa
from tidewarden.streaming.replicas import PrimaryFirst


class Handle:
    """One key's state, its timers noted."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.value

    def exists(self):
        return self.value is not None

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, ms):
        self.timers.append(ms)

    def getCurrentWatermarkInMs(self):
        return self.now


def batch(points, node, second, extra="x"):
    return pd.DataFrame([(s, us, node, extra, second, us) for s, us in points], columns=["series_id", "ts", "node", "extra", "second_", "us_"])


def test_points_given_out_are_held_as_numbers():
    handle, taken = Handle(), PrimaryFirst(["series_id", "ts", "node", "extra"], pa.string())
    taken.init(handle)
    handle.now = 0
    points = [(f"series-{i % 10}", 1_000_000 + i) for i in range(20_000)]
    out = pd.concat(taken.handleInputRows((0,), iter([batch(points, "n1", False, "long text " * 9)]), handle))
    assert len(out) == len(points)
    assert sum(map(len, handle.value)) < 20 * len(points)
    # Later copies of them are dropped, a new point of a second waits, and null series are a series.
    more = [batch(points[:100], "n0", True), batch([("new", 5_000_000), (None, 5_000_000)], "n2", True), batch([("new", 5_000_000), (None, 5_000_000)], "n0", True)]
    assert len(pd.concat(taken.handleInputRows((0,), iter(more), handle))) == 0
    # The primary's copy of a waiting point goes out at once, and only once.
    assert pd.concat(taken.handleInputRows((0,), iter([batch([(None, 5_000_000)] * 2, "n1", False)]), handle))["node"].tolist() == ["n1"]
    handle.now = 5_000
    out = pd.concat(taken.handleExpiredTimer((0,), handle, None))
    assert out[["series_id", "node"]].values.tolist() == [["new", "n0"]] and handle.value is None
    assert np.array_equal(handle.timers, [1000, 1000, 1000])
