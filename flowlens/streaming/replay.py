"""Rows of a key replayed in event time on a stream.

`EventTimeReplay` is a processor for `transformWithStateInPandas`. Rows are not
handled as they arrive, in any order within and between micro-batches, but put
by into state, in parts of PART rows under the time bucket they belong to. A
timer at the bucket's end fires once the watermark has passed it: from then on
Spark drops rows of that bucket as late, so the bucket is complete. It is
sorted, handed to `replay` and removed. A second timer ends an entry that no
row follows. Both are set when rows arrive, so they fire in order. Buckets of a key are replayed in order,
so the outcome is that of a batch over all rows that are not late, for any
order of arrival. A bucket is the most that a key holds in a worker at once;
`width_ms` sets its width. Results come one bucket and the watermark's delay
after the row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Rows in one state value.
PART = 4096


class EventTimeReplay(StatefulProcessor):
    """Subclasses give `fields` (name -> element type of the buffered columns,
    `t_us` among them), `order` (sort columns), `entry` (schema of the value
    carried from bucket to bucket) and `replay`."""

    fields: dict[str, str]
    order: list[str]
    entry: str
    width_ms = 1000
    #: How long an entry can outlive the last row of its bucket.
    hold_us = 0

    def replay(self, key: tuple, rows: pd.DataFrame, entry: tuple | None) -> tuple[pd.DataFrame | None, tuple | None]:
        """Rows of one bucket in order -> rows to emit, and the new entry."""
        raise NotImplementedError

    def expiry_us(self, entry: tuple) -> int:
        """When an entry that nothing follows is over."""
        raise NotImplementedError

    def expire(self, key: tuple, entry: tuple) -> pd.DataFrame | None:
        """Rows to emit for an entry that is over."""
        return None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "bucket long, part int",
                                       ", ".join(f"{c} array<{t}>" for c, t in self.fields.items()))
        self.parts = handle.getMapState("parts", "bucket long", "parts int")
        self.carried = handle.getValueState("entry", self.entry)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for bucket, found in pdf.groupby(pdf["t_us"] // (self.width_ms * 1000)):
                bucket = int(bucket)
                n = self.parts.getValue((bucket,))[0] if self.parts.containsKey((bucket,)) else 0
                if n == 0:
                    end = (bucket + 1) * self.width_ms
                    self.handle.registerTimer(end)
                    # an entry of this bucket that nothing follows is over by then
                    self.handle.registerTimer(end + (self.hold_us // (self.width_ms * 1000) + 1) * self.width_ms)
                for i in range(0, len(found), PART):
                    self.rows.updateValue((bucket, n), tuple(found[c].iloc[i:i + PART].tolist() for c in self.fields))
                    n += 1
                self.parts.updateValue((bucket,), (n,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        bucket = at // self.width_ms - 1
        entry = self.carried.get() if self.carried.exists() else None
        before = entry
        if self.parts.containsKey((bucket,)):
            parts = [self.rows.getValue((bucket, k)) for k in range(self.parts.getValue((bucket,))[0])]
            full = pd.DataFrame({c: np.concatenate([np.asarray(p[i]) for p in parts]) for i, c in enumerate(self.fields)})
            out, entry = self.replay(key, full.sort_values(self.order, kind="stable", ignore_index=True), entry)
            for k in range(len(parts)):
                self.rows.removeKey((bucket, k))
            self.parts.removeKey((bucket,))
            if out is not None and len(out):
                yield out
        if entry is not None and self.expiry_us(entry) <= at * 1000:
            out = self.expire(key, entry)
            if out is not None:
                yield out
            entry = None
        if entry is None:
            self.carried.clear()
        elif entry != before:
            self.carried.update(entry)
