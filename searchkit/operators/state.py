"""Keyed state: values that expire, bounded maps, bijections, sessions, and cached results."""

from __future__ import annotations

import ast
import json
import os
import re
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from email.utils import formatdate
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def live_keys(sets: DataFrame, key: str, at: str, now: Column, timeout: Column, value: str | None = None) -> DataFrame:
    """Keys last set no more than timeout before now (at the limit they live), with that time and value.

    Touching a key is setting it; what is set after now doesn't count yet.
    """
    seen = sets.where(F.col(at) <= now)
    newest = F.max(F.struct(F.col(at).alias("at"), *([F.col(value).alias("value")] if value else []))).alias("x")
    out = seen.groupBy(key).agg(newest).where(F.col("x.at") >= now - timeout)
    return out.select(key, F.col("x.at").alias(at), *([F.col("x.value").alias(value)] if value else []))


def newest_keys(sets: DataFrame, key: str, at: str, most: int) -> DataFrame:
    """The `most` keys set last (ties by key): what a map bounded by last use holds."""
    return sets.groupBy(key).agg(F.max(at).alias(at)).orderBy(F.desc(at), key).limit(most)


def duplicates(pairs: DataFrame, column: str) -> DataFrame:
    """Values that several keys have, which a bijection may not hold: none must come out."""
    return pairs.groupBy(column).agg(F.count("*").alias("keys")).where("keys > 1")


def reverse(pairs: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Value to key, made from the forward map, so that it never keeps what a key had before."""
    return pairs.select(F.col(value).alias(key), F.col(key).alias(value))


def sessions(events: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """(key, first, last, requests): the sessions of each key, which a pause of `gap` ends."""
    timed = events.select(key, F.col(at).cast("timestamp").alias("_at"))
    grouped = timed.groupBy(key, F.session_window("_at", gap)).agg(F.min("_at").alias("first"), F.max("_at").alias("last"), F.count("*").alias("requests"))
    return grouped.select(key, F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "requests")


class TimedDictionary:
    """A driver-side map whose entries expire; order is that of the last set; optionally bounded."""

    def __init__(self, timeout: float, most: int | None = None, clock: Callable[[], float] = time.time):
        self.timeout, self.most, self.clock = timeout, most, clock
        self.entries: OrderedDict[Any, tuple[Any, float]] = OrderedDict()

    def __setitem__(self, key: Any, value: Any) -> None:
        self.purge()
        self.entries.pop(key, None)
        self.entries[key] = (value, self.clock())
        while self.most is not None and len(self.entries) > self.most:
            self.entries.popitem(last=False)

    def __getitem__(self, key: Any) -> Any:
        value, at = self.entries[key]
        if self.expired(at):
            del self.entries[key]
            raise KeyError(key)
        return value

    def get(self, key: Any, default: Any = None) -> Any:
        try:
            return self[key]
        except KeyError:
            return default

    def __contains__(self, key: Any) -> bool:
        return key in self.entries and not self.expired(self.entries[key][1])

    def __len__(self) -> int:
        self.purge()
        return len(self.entries)

    def expired(self, at: float) -> bool:
        return self.clock() > at + self.timeout

    def peek(self, key: Any, default: Any = None) -> Any:
        """The value whether it has expired or not."""
        return self.entries[key][0] if key in self.entries else default

    def touch(self, key: Any) -> None:
        self[key] = self[key]

    def pop(self, key: Any) -> Any:
        value = self[key]
        del self.entries[key]
        return value

    def purge(self) -> None:
        for key in [k for k, (_, at) in self.entries.items() if self.expired(at)]:
            del self.entries[key]


class SavedTimedDictionary(TimedDictionary):
    """A timed dictionary of JSON values kept in a file, which is replaced whole after each change."""

    def __init__(self, path: str, timeout: float, most: int | None = None, clock: Callable[[], float] = time.time):
        super().__init__(timeout, most, clock)
        self.path = path
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                self.entries = OrderedDict((k, (v, at)) for k, v, at in json.load(f))

    def save(self) -> None:
        temporary = f"{self.path}.tmp"
        with open(temporary, "w", encoding="utf-8") as f:
            json.dump([(k, v, at) for k, (v, at) in self.entries.items()], f)
        os.replace(temporary, self.path)

    def __setitem__(self, key: str, value: Any) -> None:
        super().__setitem__(key, value)
        self.save()

    def pop(self, key: str) -> Any:
        value = super().pop(key)
        self.save()
        return value


@dataclass(frozen=True)
class Session:
    """A visitor's session: its id, its value (kept by reference) and the header that sets its cookie."""

    id: str
    value: Any
    header: str


class SessionStore:
    """Sessions behind cookies, in a map whose entries expire: each use puts the end off."""

    def __init__(self, entries: TimedDictionary, name: str = "session", secure: bool = False, http_only: bool = True):
        self.entries, self.name = entries, name
        self.flags = [flag for flag, on in (("Secure", secure), ("HttpOnly", http_only)) if on]

    def create(self, value: Any) -> Session:
        key = str(uuid.uuid4())
        self.entries[key] = value
        return self._session(key)

    def validate(self, key: str) -> Session | None:
        """The session of an id that hasn't expired, touched; None for any other."""
        if self.entries.get(key) is None:
            return None
        self.entries.touch(key)
        return self._session(key)

    def remove(self, key: str) -> None:
        self.entries.entries.pop(key, None)

    def remove_where(self, test: Callable[[Any], bool]) -> int:
        """Remove the sessions whose value passes a test, expired ones too; how many."""
        gone = [k for k in list(self.entries.entries) if test(self.entries.peek(k))]
        for k in gone:
            self.remove(k)
        return len(gone)

    def of_request(self, cookie_header: str | None) -> Session:
        """The session that a request's Cookie header names first, or a new one with an empty dict."""
        named = re.findall(rf"(?:^|;)\s*{re.escape(self.name)}=([^;]*)", cookie_header or "")
        return (self.validate(named[0].strip()) if named else None) or self.create({})

    def _session(self, key: str) -> Session:
        end = formatdate(self.entries.clock() + self.entries.timeout, usegmt=True)
        return Session(key, self.entries[key], "Set-Cookie: " + "; ".join([f"{self.name}={key}", "path=/", f"expires={end}", *self.flags]))


def arguments_in_session(session: dict[str, list], arguments: Mapping[str, Sequence[str]]) -> None:
    """Keep request arguments in a session: `+literal` adds to the list of its name what isn't in it, `-literal` takes
    it out, and text without a sign is added as it is. A literal is a Python constant, never code; anything else is a ValueError."""
    for name, values in arguments.items():
        kept = session.setdefault(name, [])
        for text in values:
            try:
                value = ast.literal_eval(text[1:].strip()) if text[:1] in ("+", "-") else text
            except (SyntaxError, ValueError):
                raise ValueError(f"{name}: {text!r} is no literal") from None
            if text[:1] == "-":
                if value in kept:
                    kept.remove(value)
            elif value not in kept:
                kept.append(value)


class ResultCache:
    """Results of queries by key for some time; on failure a stale one if allowed, and then a pause before the next try."""

    def __init__(self, timeout: float = 3600, stale_on_error: bool = False, backoff: float | None = None, clock: Callable[[], float] = time.time):
        self.fresh = TimedDictionary(timeout, clock=clock)
        self.all: dict[Any, Any] = {}
        self.stale_on_error, self.backoff, self.clock = stale_on_error, backoff, clock
        self.retry_at: dict[Any, float] = {}

    def get(self, key: Any, make: Callable[[], Any]) -> Any:
        if key in self.fresh:
            return self.fresh[key]
        if self.clock() < self.retry_at.get(key, 0) and key in self.all:
            return self.all[key]
        try:
            value = make()
        except Exception:
            if self.backoff is not None:
                self.retry_at[key] = self.clock() + self.backoff
            if self.stale_on_error and key in self.all:
                return self.all[key]
            raise
        self.fresh[key] = self.all[key] = value
        self.retry_at.pop(key, None)
        return value

    def clear(self) -> None:
        self.fresh.entries.clear()
        self.all.clear()
