"""URL, address and time functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from searchkit.functions.text import col


def url_parts(url: str | Column) -> Column:
    """scheme, host, port, path, query, fragment, username, password of an absolute URL; null without a host."""
    u = col(url)
    part = lambda pattern, group=1: F.regexp_extract(u, pattern, group)
    head = "^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)"
    authority = part(head, 2)
    user = F.when(authority.contains("@"), F.regexp_extract(authority, "^(.*)@", 1))
    place = F.regexp_replace(authority, "^.*@", "")
    host = F.lower(F.regexp_extract(place, r"^(\[[^\]]*\]|[^:]*)", 1))
    host = F.regexp_replace(host, r"[\[\]]", "")
    port = F.regexp_extract(place, r":(\d+)$", 1)
    scheme = F.lower(part(head))
    default = F.when(scheme == "https", 443).when(scheme == "ftp", 21).otherwise(80)
    password = F.when(user.contains(":"), F.regexp_replace(user, "^[^:]*:", ""))
    return F.when(host != "", F.struct(
        scheme.alias("scheme"), host.alias("host"), F.when(port != "", port.cast("int")).otherwise(default).alias("port"),
        part(head + "([^?#]*)", 3).alias("path"), part(head + r"[^?#]*\?([^#]*)", 3).alias("query"), part("#(.*)$").alias("fragment"),
        F.regexp_replace(user, ":.*$", "").alias("username"), password.alias("password"),
    ))


def path_and_query(uri: str | Column) -> Column:
    """A request's path, with `?query` if it has one."""
    rest = F.regexp_replace(F.regexp_replace(col(uri), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    return F.regexp_replace(rest, r"\?$", "")


def ipv4(address: str | Column) -> Column:
    """A dotted IPv4 address as a number; null for anything else."""
    octets = F.split(F.when(col(address).rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"), col(address)), r"\.")
    return F.aggregate(octets, F.lit(0).cast("long"), lambda n, octet: n * 256 + octet.cast("long"))


def seconds_until(now: str | Column, time_of_day: str, day_of_week: int | None = None) -> Column:
    """Seconds to the next HH:MM (UTC), on an ISO weekday if given; a moment that is now is a period away."""
    hours, minutes = map(int, time_of_day.split(":"))
    if day_of_week is not None and not 1 <= day_of_week <= 7:
        raise ValueError("day_of_week is 1 (Monday) to 7")
    t = col(now)
    past = F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
    ahead = F.lit(hours * 3600 + minutes * 60) - past
    if day_of_week is None:
        return F.when(ahead > 0, ahead).otherwise(ahead + 86400).cast("long")
    iso = F.weekday(t) + 1
    wait = F.pmod(F.lit(day_of_week) - iso, F.lit(7)) * 86400 + ahead
    return F.when(wait > 0, wait).otherwise(wait + 7 * 86400).cast("long")


def seconds_to_epoch(now_seconds: str | Column, target: int) -> Column:
    """Seconds to an absolute time; one that is past is a year away."""
    left = F.lit(target) - col(now_seconds)
    return F.when(left < 0, F.lit(365 * 86400)).otherwise(left)


def last_forwarded(header: str | Column) -> Column:
    """The last of a comma-separated forwarding header."""
    return F.trim(F.element_at(F.split(col(header), ","), -1))


def deproxied(client: str | Column, forwarded_for: str | Column, forwarded_host: str | Column, trusted: Column) -> Column:
    """Client, host and port behind a trusted proxy; the request's own client otherwise."""
    host = F.when(trusted, last_forwarded(forwarded_host))
    return F.struct(
        F.when(trusted & col(forwarded_for).isNotNull(), last_forwarded(forwarded_for)).otherwise(col(client)).alias("client"),
        F.substring_index(host, ":", 1).alias("host"),
        F.coalesce(F.nullif(F.regexp_extract(host, r":(\d+)$", 1), F.lit("")).cast("int"), F.lit(80)).alias("port"),
    )
