"""What a run tells on the error stream: dots while it works, the time of each phase, peak memory."""

from __future__ import annotations

import resource
import sys
import threading
import time
from contextlib import contextmanager
from typing import TextIO

INTERVAL = 5.0


class Progress:
    """Dots every ``INTERVAL`` seconds unless quiet; phases and peak memory where asked for."""

    def __init__(self, out: TextIO | None = None, quiet: bool = False, verbose: bool = False, interval: float = INTERVAL):
        self.out, self.quiet, self.verbose, self.interval = out or sys.stderr, quiet, verbose, interval
        self.phases: list[tuple[str, float]] = []
        self._dots, self._stop, self._thread = 0, threading.Event(), None

    def __enter__(self) -> Progress:
        if not self.quiet:
            self._thread = threading.Thread(target=self._beat, daemon=True)
            self._thread.start()
        return self

    def _beat(self) -> None:
        while not self._stop.wait(self.interval):
            self._dots += 1
            self._write(".")

    def _write(self, text: str) -> None:
        try:
            self.out.write(text)
            self.out.flush()
        except (OSError, ValueError):  # a closed stream doesn't end the run
            pass

    def __exit__(self, *_) -> None:
        self._stop.set()
        if self._thread:
            self._thread.join()
        if self._dots:
            self._write("\n")
        if self.verbose:
            for name, seconds in self.phases:
                self._write(f"phase {name}: {seconds:.3f} s\n")
            self._write(f"peak memory: {resource.getrusage(resource.RUSAGE_SELF).ru_maxrss} KiB\n")

    @contextmanager
    def phase(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.phases.append((name, time.perf_counter() - began))
