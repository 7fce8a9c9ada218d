import json
import re

import pytest

from searchkit.functions.text import PUNCTUATION, tokens
from searchkit.operators import fields, state, suggest
from searchkit.plans import render
from searchkit.plans.requests import parse_sru
from searchkit.streaming.inbox import Inbox
from searchkit.streaming.upsert import UpsertTable


def test_sessions_behind_cookies():
    now = [1000.0]
    store = state.SessionStore(state.TimedDictionary(60, clock=lambda: now[0]), "shop", secure=True)
    first = store.of_request(None)
    assert first.value == {} and first.header == f"Set-Cookie: shop={first.id}; path=/; expires=Thu, 01 Jan 1970 00:17:40 GMT; Secure; HttpOnly"
    first.value["seen"] = 1
    now[0] += 50
    again = store.of_request(f"a=b; shop={first.id}; shop=other")
    assert again.id == first.id and again.value == {"seen": 1}
    now[0] += 50  # touched 50 seconds ago
    assert store.validate(first.id).value == {"seen": 1} and store.validate("unknown") is None
    now[0] += 61
    assert store.validate(first.id) is None and store.of_request(f"shop={first.id}").id != first.id
    some = store.create({"user": 1})
    assert store.remove_where(lambda v: v.get("user") == 1) == 1 and store.validate(some.id) is None
    store.remove("unknown")


def test_arguments_in_session():
    session: dict = {}
    state.arguments_in_session(session, {"a": ["+1", "+'x'", "plain", "+1"], "b": ["-2"], "c": [""]})
    assert session == {"a": [1, "x", "plain"], "b": [], "c": [""]}
    state.arguments_in_session(session, {"a": ["-1", "-('x', 2)", "-'x'"]})
    assert session["a"] == ["plain"]
    for bad in ("+__import__('os')", "+1 +", "-"):
        with pytest.raises(ValueError):
            state.arguments_in_session(session, {"a": [bad]})


def test_records_with_extra_data():
    request = parse_sru({"version": ["1.1"], "operation": ["searchRetrieve"], "query": ["x"], "x-recordSchema": ["more"]})
    hit = {"id": "1", "data": {"dc": "<a/>", "more": "<b/>"}, "duplicate_count": {"key": 3}, "extra": ["<own/>"]}
    new, old = (render.sru_response(request, 5, [hit], extra_request_data=["<asked/>"], extra_data=[render.total_with_duplicates(9)], old_style=o) for o in (False, True))
    assert "<srw:extraRecordData><own/><srw:duplicateCount" in new and "fieldname=\"key\">3</srw:duplicateCount><srw:record>" in new
    assert '<recordData recordSchema="more"><b/></recordData></srw:extraRecordData>' in old
    assert "<srw:extraRequestData><asked/></srw:extraRequestData></srw:echoedSearchRetrieveRequest>" in new and ">9</srw:numberOfRecordsWithDuplicates>" in new
    assert "<srw:nextRecordPosition>2</srw:nextRecordPosition>" in new
    assert "nextRecordPosition" not in render.sru_response(request, 1, [hit]) and "nextRecordPosition" not in render.sru_response(request, 5, [])


def test_subtrees_of_bad_records(spark):
    rows = spark.createDataFrame([("1", "<r><a>x</a>tail<a/></r>"), ("2", "<r><a>"), ("3", None), ("4", "<r/>")], "identifier string, xml string")
    got = [(r["identifier"], r["xml"], r["error"] is None) for r in fields.select_subtrees(rows, "a").collect()]
    assert got == [("1", "<a>x</a>", True), ("1", "<a />", True), ("2", None, False)]


def test_paths_of_bad_records(spark):
    rows = spark.createDataFrame([("1", "<r><a>x</a><a>y</a></r>"), ("2", "<r><a>"), ("3", None), ("4", "text")], "identifier string, xml string")
    got = [(r["identifier"], r["name"], r["value"]) for r in fields.xpath_fields(rows, {"a": "/r/a/text()"}).collect()]
    assert got == [("1", "a", "x"), ("1", "a", "y")]
    assert {r["identifier"]: r["value"] for r in fields.xpath_fields(rows, {"a": "/r/a/text()"}, as_list=True).collect()} == {"1": ["x", "y"], "2": None, "3": None, "4": None}


def test_upserts_rewrite_only_touched_buckets(spark, tmp_path):
    table = UpsertTable(spark, str(tmp_path), ["k"], ["seq"], buckets=8)
    batch = lambda *rows: spark.createDataFrame(rows, "k string, seq long, v string, is_deleted boolean")
    table.fold(batch(*[(f"k{i}", 1, "x", False) for i in range(40)]), 0, "one")
    before = table.manifest()["buckets"]
    table.fold(batch(("k3", 2, "y", False)), 1, "one")
    after = table.manifest()["buckets"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    table.fold(batch(("k3", 9, "replayed", False)), 1, "one")
    table.fold(batch(("k4", 3, "z", False), ("new", 1, "w", False)), 0, "two")  # another query's first batch
    table.fold(batch(), 2, "one")
    rows = {r["k"]: r["v"] for r in table.live().collect()}
    assert len(rows) == 41 and (rows["k3"], rows["k4"], rows["new"], rows["k5"]) == ("y", "z", "w", "x")
    assert table.manifest()["sources"] == {"one": 2, "two": 0} and len(table.versions()) == 2
    named = {f for m in tmp_path.glob("manifests/*.json") for f in json.loads(m.read_text())["buckets"].values()}
    assert {str(p.relative_to(tmp_path)) for p in tmp_path.glob("data/*/_bucket=*")} == named


def test_inbox_reads_on_the_executors(spark, tmp_path):
    inbox, done = tmp_path / "in", tmp_path / "done"
    inbox.mkdir()
    done.mkdir()
    got: list = []
    box = Inbox(spark, str(inbox), str(done), lambda df: got.extend(map(tuple, df.collect())))
    (inbox / "a [1].xml").write_text("<é/>", encoding="utf-8")
    (inbox / "bad.xml").write_text("<a>")
    (inbox / "latin.xml").write_bytes(b"<a>\xe9</a>")
    assert box.process() == 3 and got == [("a [1].xml", "<é/>")] and box.process() == 0
    assert {p.name for p in done.iterdir() if p.suffix != ".crc"} == {"a [1].xml", "bad.xml", "bad.xml.error", "latin.xml", "latin.xml.error"}
    (inbox / "c.xml").write_text("<c/>")

    def fails(df):
        raise RuntimeError("no room")

    box.add = fails
    assert box.process() == 1 and "no room" in (done / "c.xml.error").read_text()


def test_tokens_by_pattern(spark):
    texts = ["", "  x  ", "(Hello), «World»! a b. ab --cd-- e-f 'g' ''h'' É. ...", "x yz w1 !!a!! a!b", "İstanbul ΑΣ.", None]
    got = [r["t"] for r in spark.createDataFrame([(t,) for t in texts], "v string").select(tokens("v").alias("t")).collect()]
    want = [None if t is None else [x for x in (w.strip(PUNCTUATION).lower() for w in re.split(r"\s+", t)) if len(x) > 1] for t in texts]
    assert [g if g is None else [x.replace("ς", "σ") for x in g] for g in got] == [w if w is None else [x.replace("ς", "σ") for x in w] for w in want]


def test_vocabulary_table(spark, tmp_path):
    docs = spark.createDataFrame([("one two two",), ("two three",)], "text string")
    kept = suggest.Vocabulary(spark, str(tmp_path / "v"))
    assert not kept.exists
    kept.refresh(docs, "text")
    assert kept.exists and {r["term"]: r["df"] for r in kept.terms.collect()} == {"one": 1, "two": 2, "three": 1}
    assert [r["term"] for r in suggest.prefix_suggest(kept.terms, "t", minimum=1).collect()] == ["two", "three"]
    kept.refresh(docs.limit(1), "text")
    assert kept.terms.count() == 2


def test_tcp_packets_are_whole_connections():
    import socket
    import threading

    from searchkit.sources.remote import _PacketReader

    with socket.socket(socket.AF_INET, socket.SOCK_STREAM) as s:
        s.bind(("127.0.0.1", 0))
        port = s.getsockname()[1]
    reader = _PacketReader({"port": str(port), "protocol": "tcp", "wait": "5", "maxPackets": "3", "connectionTimeout": "1"})

    def send():
        for text in ("first\npäcket", "", "x" * 200_000):
            for _ in range(100):
                try:
                    with socket.create_connection(("127.0.0.1", port), timeout=5) as c:
                        c.sendall(text[:5].encode())
                        c.sendall(text[5:].encode())
                    break
                except ConnectionRefusedError:
                    threading.Event().wait(0.05)

    sender = threading.Thread(target=send)
    sender.start()
    rows, end = reader.read({"n": 7})
    sender.join()
    rows = list(rows)
    assert [(r[0], r[1]) for r in rows] == [(7, "first\npäcket"), (8, ""), (9, "x" * 200_000)] and end == {"n": 10}
    reader.socket.close()
