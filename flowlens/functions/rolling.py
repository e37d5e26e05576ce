"""Order statistics over trailing frames: a sorted frame is kept and advanced by a row, not sorted anew for each row.

Rows come in Arrow batches, dealt out by key and sorted; a frame's values lie in
a sorted list, in which the row that leaves and the row that enters are found by
bisection.  The state of a key is one frame, whatever the length of its series,
and is carried from batch to batch.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Frame:
    """The values of a frame in order; ``places`` are those at which rows entered."""

    def __init__(self) -> None:
        self.ordered: list[float] = []
        self.entered: deque[tuple[int, float]] = deque()

    def leave(self, before: int) -> None:
        """Rows that entered at places less than ``before`` go."""
        while self.entered and self.entered[0][0] < before:
            _, value = self.entered.popleft()
            del self.ordered[bisect_left(self.ordered, value)]

    def enter(self, place: int, value: float) -> None:
        insort(self.ordered, value)
        self.entered.append((place, value))

    def quantile(self, q: float) -> float | None:
        """Between neighbours by a straight line."""
        if not self.ordered:
            return None
        at = q * (len(self.ordered) - 1)
        low = int(at)
        part = at - low
        return self.ordered[low] if part == 0 else self.ordered[low] * (1 - part) + self.ordered[low + 1] * part


def trailing(df: DataFrame, keys: list[str], value: str, width: int, quantiles: dict[str, float] | None = None, seen: str | None = None, up_to: str | None = None, by_sessions: bool = False, current: bool = True, order: str = "t") -> DataFrame:
    """Adds order statistics of each row's frame: the ``width`` last valid rows, or with ``by_sessions`` those of the ``width`` last sessions.

    ``quantiles``: output column by share; ``seen``: column for the number of
    values in the frame; ``up_to``: column for how many of them are no greater than the
    row's own value. With ``current`` the row itself belongs to the frame, else it
    ends before it. Null and NaN values are in no frame; their rows get the frame's statistics,
    ``up_to`` null. Without keys all rows form one series, which must be short: a row a session.
    """
    quantiles = quantiles or {}
    new = [(name, T.DoubleType()) for name in quantiles] + [(name, T.LongType()) for name in (seen, up_to) if name]
    schema = T.StructType([*df.schema.fields, *(T.StructField(name, kind) for name, kind in new)])

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, frame, count = None, Frame(), 0
        for batch in batches:
            place = batch.column(order).to_pylist()
            series = zip(*(batch.column(k).to_pylist() for k in keys)) if keys else ((),) * len(place)
            out: dict[str, list] = {name: [] for name, _ in new}
            for key, at, v in zip(series, place, batch.column(value).to_pylist()):
                if key != now:
                    now, frame, count = key, Frame(), 0
                valid = v is not None and v == v
                spot = at if by_sessions else count
                frame.leave(spot - width + (1 if current and (valid or by_sessions) else 0))
                if current and valid:
                    frame.enter(spot, v)
                for name, q in quantiles.items():
                    out[name].append(frame.quantile(q))
                if seen:
                    out[seen].append(len(frame.ordered))
                if up_to:
                    out[up_to].append(bisect_right(frame.ordered, v) if valid else None)
                if not current and valid:
                    frame.enter(spot, v)
                count += valid
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(out[name], pa.float64() if kind == T.DoubleType() else pa.int64()) for name, kind in new)], [*batch.schema.names, *out])

    dealt = df.repartition(*keys) if keys else df.repartition(1)
    return dealt.sortWithinPartitions(*keys, order).mapInArrow(advance, schema)
