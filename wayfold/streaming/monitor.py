"""What a stream tells of itself, and rows that leave it one by one.

``Progress`` is a query listener: it keeps the events of queries that arrive, the
last ``KEPT`` of them. ``RowFiles`` is a row writer with open, process and close,
which runs where the rows are: each task of each batch has a file of its own,
which appears whole when the task closes without an error, so a task or a batch
that runs again replaces its own file and adds no second one.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections import deque

from pyspark.sql import Row
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

from wayfold.sources.trajectory_text import opened

KEPT = 1000


class Progress(StreamingQueryListener):
    """Events of streams, by run: started, progress (rows read, observed metrics), terminated."""

    def __init__(self):
        self.events: deque[tuple[str, str, dict]] = deque(maxlen=KEPT)
        self.ended: dict[str, threading.Event] = {}

    def _of(self, run) -> threading.Event:
        return self.ended.setdefault(str(run), threading.Event())

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        self.events.append((str(event.runId), "started", {"name": event.name}))

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        observed = {name: row.asDict() for name, row in p.observedMetrics.items()}
        self.events.append((str(p.runId), "progress", {"batch": p.batchId, "rows": p.numInputRows, "observed": observed}))

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        self.events.append((str(event.runId), "idle", {}))

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        self.events.append((str(event.runId), "terminated", {"error": event.exception}))
        self._of(event.runId).set()

    def of(self, run, wait: float = 60.0) -> list[tuple[str, dict]]:
        """The events of a run, after it has ended; events arrive a little after what they tell of."""
        self._of(run).wait(wait)
        return [(kind, data) for r, kind, data in self.events if r == str(run)]


class RowFiles:
    """Rows as JSON lines in a folder that driver and executors share."""

    def __init__(self, path: str):
        self.path = path

    def open(self, partition: int, epoch: int) -> bool:
        self.name, self.rows = f"{epoch:010d}-{partition:05d}.json", []
        self.system, self.root = opened(self.path)
        self.system.create_dir(self.root, recursive=True)
        self.hidden = f"{self.root}/.{uuid.uuid4().hex}"
        self.out = self.system.open_output_stream(self.hidden)
        return True

    def process(self, row: Row) -> None:
        self.out.write((json.dumps(row.asDict(True), default=str) + "\n").encode())

    def close(self, error: Exception | None) -> None:
        self.out.close()
        if error is None:
            self.system.move(self.hidden, f"{self.root}/{self.name}")
        else:
            self.system.delete_file(self.hidden)
