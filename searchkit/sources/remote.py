"""Remote sources as Python data sources: paged SRU scans, polled HTTP, datagrams; and an update client."""

from __future__ import annotations

import gzip
import socket
import time
import urllib.error
import urllib.request
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import urlencode
from xml.sax.saxutils import escape

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType


def _local(element: ET.Element) -> str:
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


@dataclass(frozen=True)
class SruPage:
    total: int
    records: list[tuple[str | None, str, str, str]]  # identifier, schema, packing, data
    following: int | None


def parse_page(body: bytes | str) -> SruPage:
    """One searchRetrieve response."""
    root = ET.fromstring(body)
    texts = {_local(e): e.text for e in root if e.text}
    records = []
    for record in (r for e in root if _local(e) == "records" for r in e):
        parts = {_local(e): e for e in record}
        packing = (parts["recordPacking"].text or "xml") if "recordPacking" in parts else "xml"
        data = parts["recordData"]
        if packing == "xml":
            for e in data:
                e.tail = None
            value = ET.tostring(data[0], encoding="unicode") if len(data) else ""
        elif packing in ("string", "text"):
            value = data.text or ""
        else:
            raise ValueError(f"unknown record packing {packing!r}")
        identifier = parts["recordIdentifier"].text if "recordIdentifier" in parts else None
        records.append((identifier, parts["recordSchema"].text if "recordSchema" in parts else "", packing, value))
    following = texts.get("nextRecordPosition")
    return SruPage(int(texts.get("numberOfRecords", 0)), records, int(following) if following else None)


def fetch(url: str, timeout: float = 30, headers: dict[str, str] | None = None) -> bytes:
    """The body of a GET that succeeds, decompressed."""
    request = urllib.request.Request(url, headers={"Accept-Encoding": "gzip, deflate"} | (headers or {}))
    with urllib.request.urlopen(request, timeout=timeout) as response:
        if response.status != 200:
            raise ValueError(f"Unexpected status code {response.status}")
        return decompress(response.read(), response.headers.get("Content-Encoding"))


def decompress(body: bytes, encoding: str | None) -> bytes:
    if encoding in (None, "", "identity"):
        return body
    if encoding in ("gzip", "x-gzip"):
        return gzip.decompress(body)
    if encoding == "deflate":
        return zlib.decompress(body)
    raise ValueError(f"Bad Content-Encoding: {encoding}")


def iterate_sru(url: str, query: str, schema: str, packing: str = "xml", maximum: int = 50, start: int = 1, stop: int | None = None, get: Callable[[str], bytes] = fetch) -> Iterator[tuple[str | None, str, str, str]]:
    """Records of a query, following nextRecordPosition until it is absent (or reaches stop)."""
    position: int | None = start
    while position is not None and (stop is None or position < stop):
        size = maximum if stop is None else min(maximum, stop - position)
        arguments = {"version": "1.2", "operation": "searchRetrieve", "query": query, "recordSchema": schema, "recordPacking": packing, "startRecord": position, "maximumRecords": size}
        page = parse_page(get(f"{url}?{urlencode(arguments)}"))
        yield from page.records
        position = page.following


@dataclass
class _Range(InputPartition):
    start: int
    stop: int


class _SruReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> Sequence[InputPartition]:
        o = self.options
        total = parse_page(fetch(f"{o['url']}?{urlencode({'version': '1.2', 'operation': 'searchRetrieve', 'query': o['query'], 'maximumRecords': 0})}")).total
        step = int(o.get("partitionSize", 1000))
        return [_Range(a, min(a + step, total + 1)) for a in range(1, total + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        o = self.options
        yield from iterate_sru(o["url"], o["query"], o.get("recordSchema", "dc"), o.get("recordPacking", "xml"), int(o.get("maximumRecords", 50)), partition.start, partition.stop)


class SruSource(DataSource):
    """`spark.read.format("sru")` with url, query, recordSchema, recordPacking, maximumRecords, partitionSize: a partition a range of positions."""

    @classmethod
    def name(cls) -> str:
        return "sru"

    def schema(self) -> str:
        return "identifier string, record_schema string, record_packing string, data string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SruReader(dict(self.options))


class _PollReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        """One poll: a refused connection or a failing server gives no row, and the next trigger tries again."""
        try:
            row = (start["n"], fetch(self.options["url"], float(self.options.get("timeout", 30))).decode(), None)
        except (OSError, ValueError, urllib.error.URLError) as e:
            if self.options.get("reportErrors", "false") != "true":
                time.sleep(float(self.options.get("retryAfter", 0)))
                return iter([]), start
            row = (start["n"], None, f"{type(e).__name__}: {e}")
        return iter([row]), {"n": start["n"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([])  # what a poll gave can't be asked for again


class PollSource(DataSource):
    """`spark.readStream.format("poll")` with url, timeout, retryAfter, reportErrors: one row for each poll; its trigger is its schedule."""

    @classmethod
    def name(cls) -> str:
        return "poll"

    def schema(self) -> str:
        return "poll long, body string, error string"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _PollReader(dict(self.options))


class _PacketReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.wait = float(options.get("wait", 0.2))
        self.most = int(options.get("maxPackets", 10_000))
        self.patience = float(options.get("connectionTimeout", 5))
        self.kind = {"udp": socket.SOCK_DGRAM, "tcp": socket.SOCK_STREAM}[options.get("protocol", "udp").lower()]
        self.address = (options.get("host", "127.0.0.1"), int(options["port"]))
        self.socket: socket.socket | None = None

    def initialOffset(self) -> dict:
        return {"n": 0}

    def _listen(self) -> socket.socket:
        listening = socket.socket(socket.AF_INET, self.kind)
        if self.kind == socket.SOCK_STREAM:
            listening.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
        listening.bind(self.address)
        if self.kind == socket.SOCK_STREAM:
            listening.listen()
        return listening

    def _packet(self, listening: socket.socket) -> tuple[bytes, tuple[str, int]]:
        """A datagram, or all that a connection sends until it is closed (or silent for too long)."""
        if self.kind == socket.SOCK_DGRAM:
            return listening.recvfrom(2048)
        connection, remote = listening.accept()
        with connection:
            connection.settimeout(self.patience)
            received = []
            try:
                while piece := connection.recv(65_536):
                    received.append(piece)
            except OSError:
                pass
            return b"".join(received), remote

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if self.socket is None:  # only the reader that plans listens; others are made to read what is cached
            self.socket = self._listen()
        rows, until = [], time.time() + self.wait
        while time.time() < until and len(rows) < self.most:
            self.socket.settimeout(max(0.001, until - time.time()))
            try:
                data, remote = self._packet(self.socket)
            except TimeoutError:
                break
            rows.append((start["n"] + len(rows), data.decode("utf-8", "replace"), remote[0], remote[1]))
        return iter(rows), {"n": start["n"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([])  # packets are sent once


class PacketSource(DataSource):
    """`spark.readStream.format("packets")` with host, port and protocol: UDP datagrams of up to 2048 bytes, or for `tcp` what each connection sends up to its end."""

    @classmethod
    def name(cls) -> str:
        return "packets"

    def schema(self) -> str:
        return "n long, data string, host string, port int"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _PacketReader(dict(self.options))


def register(spark) -> None:
    for source in (SruSource, PollSource, PacketSource):
        spark.dataSource.register(source)


class UpdateError(Exception):
    """The server didn't take an update."""


def update_envelope(identifier: str, action: str, data: str | None = None, schema: str = "rdf") -> str:
    record = f"<srw:record><srw:recordPacking>xml</srw:recordPacking><srw:recordSchema>{escape(schema)}</srw:recordSchema><srw:recordData>{data}</srw:recordData></srw:record>" if data is not None else ""
    return f'<ucp:updateRequest xmlns:ucp="info:lc/xmlns/update-v1" xmlns:srw="http://www.loc.gov/zing/srw/"><srw:version>1.0</srw:version><ucp:action>info:srw/action/1/{action}</ucp:action><ucp:recordIdentifier>{escape(identifier)}</ucp:recordIdentifier>{record}</ucp:updateRequest>'


def post_update(url: str, envelope: str, timeout: float = 30) -> None:
    """Send one update; anything but a success raises."""
    request = urllib.request.Request(url, envelope.encode(), {"Content-Type": "text/xml"})
    with urllib.request.urlopen(request, timeout=timeout) as response:
        body = response.read()
    status = next((e.text for e in ET.fromstring(body).iter() if _local(e) == "operationStatus"), None)
    if status != "success":
        raise UpdateError(body.decode("utf-8", "replace"))


def send_updates(updates, url: str) -> None:
    """A sink: rows (identifier, action, data) posted from the executors, each partition in order."""

    def send(rows) -> None:
        for r in rows:
            post_update(url, update_envelope(r["identifier"], r["action"], r["data"]))

    updates.foreachPartition(send)
