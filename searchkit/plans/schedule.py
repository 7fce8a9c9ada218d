"""Schedules, and calls repeated by them, on the driver."""

from __future__ import annotations

import datetime as dt
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Schedule:
    """A period in seconds; or a time of day (UTC, HH:MM) with an optional ISO weekday; or an absolute time."""

    period: float | None = None
    time_of_day: str | None = None
    day_of_week: int | None = None
    epoch: float | None = None

    def __post_init__(self) -> None:
        given = [self.period is not None, self.time_of_day is not None, self.epoch is not None]
        if sum(given) != 1 or self.day_of_week is not None and self.time_of_day is None:
            raise ValueError("specify either a period, or a time of day with an optional weekday, or an absolute time")
        if self.day_of_week is not None and not 1 <= self.day_of_week <= 7:
            raise ValueError("day_of_week is 1 (Monday) to 7")

    def seconds(self, now: float | None = None) -> float:
        """Seconds from now to the next moment; a moment that is now is a whole period away."""
        now = time.time() if now is None else now
        if self.period is not None:
            return self.period
        if self.epoch is not None:
            return self.epoch - now if self.epoch >= now else 365 * 86400
        at = dt.datetime.fromtimestamp(now, dt.UTC)
        hours, minutes = map(int, self.time_of_day.split(":"))
        ahead = hours * 3600 + minutes * 60 - (at.hour * 3600 + at.minute * 60 + at.second)
        if self.day_of_week is None:
            return ahead if ahead > 0 else ahead + 86400
        wait = (self.day_of_week - at.isoweekday()) % 7 * 86400 + ahead
        return wait if wait > 0 else wait + 7 * 86400


@dataclass
class PeriodicCall:
    """Calls something by a schedule, and after a failure by another; it can be paused and resumed.

    For streams a query's trigger is the schedule; this drives what is not a stream (an inbox, a poll, a rotation).
    """

    call: Callable[[], object]
    schedule: Schedule
    on_error: Schedule = Schedule(period=15)
    initial: Schedule = Schedule(period=0)
    log: Callable[[str], None] = print
    state: dict = field(default_factory=lambda: {"paused": True, "calls": 0, "errors": 0, "last_error": None})

    def __post_init__(self) -> None:
        self._timer: threading.Timer | None = None
        self._lock = threading.RLock()

    def resume(self) -> None:
        with self._lock:
            if self.state["paused"]:
                self.state["paused"] = False
                self._wait(self.initial)

    def pause(self) -> None:
        with self._lock:
            self.state["paused"] = True
            if self._timer is not None:
                self._timer.cancel()

    def run(self) -> None:
        """One call now; what comes next depends on how it went."""
        following = self.schedule
        try:
            self.call()
        except Exception as e:
            self.state["errors"] += 1
            self.state["last_error"] = f"{type(e).__name__}: {e}"
            self.log(self.state["last_error"])
            following = self.on_error
        self.state["calls"] += 1
        with self._lock:
            if not self.state["paused"]:
                self._wait(following)

    def _wait(self, schedule: Schedule) -> None:
        self._timer = threading.Timer(schedule.seconds(), self.run)
        self._timer.daemon = True
        self._timer.start()
