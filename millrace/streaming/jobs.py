"""A queue of analyses on the driver: one worker, a bounded number of waiting jobs, states on disk."""

from __future__ import annotations

import json
import os
import queue
import threading
import uuid
from collections.abc import Callable
from pathlib import Path

STATES = ("queued", "validating", "running", "complete", "failed", "interrupted")


class Full(Exception):
    """As many jobs wait as may."""


class Jobs:
    """submit() puts a job in line or raises Full. The worker calls validate(payload), then run(payload),
    one job at a time; each state is written before it is entered. A job found in an unfinished state when
    the folder is opened is interrupted: nothing is run twice."""

    def __init__(self, folder: str, validate: Callable[[dict], None], run: Callable[[dict], dict], waiting: int = 3):
        self.folder, self._validate, self._run = Path(folder), validate, run
        self.folder.mkdir(parents=True, exist_ok=True)
        for job in self.all():
            if job["state"] not in ("complete", "failed", "interrupted"):
                self._write(job | {"state": "interrupted"})
        self._line: queue.Queue = queue.Queue(waiting)
        self._worker = threading.Thread(target=self._work, daemon=True)
        self._worker.start()

    def _write(self, job: dict) -> None:
        at = self.folder / f"{job['id']}.json"
        new = at.with_suffix(".new")
        new.write_text(json.dumps(job, sort_keys=True))
        os.replace(new, at)

    def state(self, job_id: str) -> dict:
        return json.loads((self.folder / f"{job_id}.json").read_text())

    def all(self) -> list[dict]:
        return [json.loads(p.read_text()) for p in sorted(self.folder.glob("*.json"))]

    def submit(self, payload: dict) -> str:
        job = {"id": uuid.uuid4().hex, "state": "queued", "payload": payload}
        self._write(job)
        try:
            self._line.put_nowait(job)
        except queue.Full:
            (self.folder / f"{job['id']}.json").unlink()
            raise Full(f"{self._line.maxsize} jobs are waiting") from None
        return job["id"]

    def _work(self) -> None:
        while (job := self._line.get()) is not None:
            try:
                self._write(job | {"state": "validating"})
                self._validate(job["payload"])
                self._write(job | {"state": "running"})
                self._write(job | {"state": "complete", "result": self._run(job["payload"])})
            except Exception as error:  # a job's fault ends the job, not the worker
                self._write(job | {"state": "failed", "error": f"{type(error).__name__}: {error}"})

    def close(self) -> None:
        """Ends the worker after the jobs in line."""
        self._line.put(None)
        self._worker.join()
