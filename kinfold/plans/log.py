"""The last lines of the library's log, for a user interface."""

from __future__ import annotations

import logging
from collections import deque


class Tail(logging.Handler):
    """Keeps the last ``kept`` records as lines, from ``level`` on; attach it to the logger "kinfold"."""

    def __init__(self, level: int = logging.INFO, kept: int = 1000):
        super().__init__(level)
        self.kept: deque[str] = deque(maxlen=kept)
        self.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))

    def emit(self, record: logging.LogRecord) -> None:
        self.kept.append(self.format(record))

    def lines(self, last: int | None = None) -> list[str]:
        return list(self.kept)[-last:] if last else list(self.kept)
