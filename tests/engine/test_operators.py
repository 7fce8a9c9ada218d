import datetime as dt
import gzip
import http.server
import os
import threading

import pytest
from pyspark.sql import functions as F

from searchkit.functions import net, numeric, text
from searchkit.operators import facets, fields, ingest, parts, requests, sets, state
from searchkit.plans import cql
from searchkit.plans.compile import Dataset, compile_query
from searchkit.plans.engine import execute
from searchkit.plans.requests import Facet, SortKey
from searchkit.sources import config, logs, remote
from searchkit.streaming.inbox import Inbox
from searchkit.streaming.upsert import UpsertTable


def values(spark, rows, kind, column):
    frame = spark.createDataFrame([(r,) for r in rows], f"x {kind}")
    return [r[0] for r in frame.select(column).collect()]


def test_tokens(spark):
    assert values(spark, ["The  quick, (brown) fox!", "a bb 'c' d-e", None, ""], "string", text.tokens("x")) == [["the", "quick", "brown", "fox"], ["bb", "d-e"], None, []]


def test_scaled(spark):
    assert values(spark, ["0.5", "-0.5", "1.25", "267.5"], "string", numeric.scaled("x", 0)) == [1, -1, 1, 268]
    assert values(spark, ["1.255", "12"], "string", numeric.scaled("x", 2)) == [126, 1200] and values(spark, ["15", "14"], "string", numeric.scaled("x", -1)) == [2, 1]


def test_radix_and_versions(spark):
    assert values(spark, [1234, 0], "long", numeric.radix_terms("x", 4)) == [["zzz4", "zz3z", "z2zz", "1zzz"], ["zzz0", "zz0z", "z0zz", "0zzz"]]
    assert values(spark, [35 * 34 + 9], "long", numeric.radix_terms("x", 2, 35)) == [["z9", "yz"]]
    assert values(spark, ["1.2.3", "4"], "string", numeric.major_version("x")) == ["1.2", "4.0"] and values(spark, ["1.2.3"], "string", numeric.major_version("x", following=True)) == ["1.3"]


@pytest.mark.parametrize("url, want", [
    ("http://h", ("http", "h", 80, "", "", "", None, None)), ("https://H.org:8080/p?q=1#f", ("https", "h.org", 8080, "/p", "q=1", "f", None, None)), ("ftp://u:p@h/x", ("ftp", "h", 21, "/x", "", "", "u", "p")),
    ("http://u@h", ("http", "h", 80, "", "", "", "u", None)), ("https://[::1]/a", ("https", "::1", 443, "/a", "", "", None, None)), ("/path", None), ("", None),
])
def test_urls(spark, url, want):
    got = values(spark, [url], "string", net.url_parts("x"))[0]
    assert (tuple(got) if got else None) == want


def test_small_formats(spark):
    assert values(spark, ["a b*~é/"], "string", text.quote_plus("x")) == ["a+b%2A~%C3%A9%2F"] and values(spark, ["a b/é"], "string", text.quote("x")) == ["a%20b/%C3%A9"]
    assert values(spark, ["a=1&b=x+y&a=%C3%A9"], "string", text.form_argument("x", "a")) == [["1", "é"]] and values(spark, ["a=1"], "string", text.form_argument("x", "z")) == [None]
    assert values(spark, ["s=1; t=2;s=3=4"], "string", text.cookie("x", "s")) == [["1", "3=4"]]
    assert values(spark, ["Basic dTpwOnE=", "Bearer x", None, "Basic ???"], "string", text.basic_auth("x")) == [("u", "p:q"), None, None, None]
    assert values(spark, ["a.b.c", "a"], "string", text.split_name("x")) == [("//a/b", "c"), ("", "a")]
    assert values(spark, ["a.b", "a b", "x"], "string", text.dotted_to_xml("x", F.lit("<v>"))) == ["<a><b>&lt;v&gt;</b></a>", None, "<x>&lt;v&gt;</x>"]
    assert values(spark, ["a+b%20c", "a"], "string", text.filename_variants("x")) == [["a+b%20c", "a+b c", "a b c"], ["a"]]
    assert values(spark, ['{"a":1}', "[", " {", "x"], "string", text.json_kind("x")) == ["dict", "list", None, None]
    assert values(spark, ["<&>"], "string", text.xml_unescape(text.xml_escape("x"))) == ["<&>"] and values(spark, ["a'\"<"], "string", text.html_escape("x")) == ["a&#x27;&quot;&lt;"]
    assert len(values(spark, ["x" * 3000], "string", text.shorten("x"))[0]) == 1505


def test_times_and_addresses(spark):
    now = [dt.datetime(2024, 1, 1, 12, 0, 0), dt.datetime(2024, 1, 1, 11, 59, 0), dt.datetime(2024, 1, 1, 12, 0, 1)]  # a Monday
    assert values(spark, now, "timestamp", net.seconds_until("x", "12:00")) == [86400, 60, 86399]
    assert values(spark, now, "timestamp", net.seconds_until("x", "12:00", 1)) == [604800, 60, 604799] and values(spark, now[:1], "timestamp", net.seconds_until("x", "11:00", 2)) == [82800]
    assert values(spark, [100, 300], "long", net.seconds_to_epoch("x", 200)) == [100, 365 * 86400]
    with pytest.raises(ValueError):
        net.seconds_until("x", "12:00", 0)
    ok = requests.ip_allowed(F.col("x"), ["1.2.3.4"], ["10.0.0.0/30", ("9.0.0.1", "9.0.0.3")])
    assert values(spark, ["1.2.3.4", "10.0.0.3", "10.0.0.4", "9.0.0.2", None, "x"], "string", F.coalesce(ok, F.lit(False))) == [True, True, False, True, False, False]
    assert requests.merged_ranges([(5, 9), (1, 2), (3, 4), (20, 30), (22, 25)]) == [(1, 9), (20, 30)]
    assert values(spark, ["9.9.9.9, 1.1.1.1"], "string", net.deproxied(F.lit("127.0.0.1"), "x", F.lit("a, b:81"), F.lit(True))) == [("1.1.1.1", "b", 81)]


DOCS = [("1", "The quick brown fox", "en", ["a", "b", "a"], 5), ("2", "the lazy dog", None, ["b"], None), ("3", "quick dog quick", "nl", None, 7), ("4", None, "en", [], 5)]


@pytest.fixture(scope="module")
def data(spark):
    return Dataset(spark.createDataFrame(DOCS, "id string, text string, lang string, tags array<string>, n long"), "id", text=("text",), default=("text",))


@pytest.mark.parametrize("query, ids", [
    ("quick", "13"), ("QUICK", "13"), ('"quick brown"', "1"), ('"brown quick"', ""), ("qui*", "13"), ("text=dog AND quick", "3"), ("quick NOT lang exact en", "3"), ("the NOT lang exact en", "2"), ("*", "1234"), ("* NOT quick", "24"),
    ("lang=en OR lang=nl", "134"), ("tags=b", "12"), ("tags exact a", "1"), ("n > 5", "3"), ("n <> 5", "3"), ("n = x", ""), ("a", ""), ('"..."', ""),
])
def test_compiled(data, query, ids):
    assert "".join(sorted(r["id"] for r in data.frame.where(compile_query(cql.parse(query), data)).collect())) == ids


def test_engine(data):
    with pytest.raises(cql.CqlError):
        execute(data, cql.parse("nope=1"))
    out = execute(data, cql.ALL, 0, 3, [SortKey("n", True)], [Facet("tags"), Facet("lang", 1), Facet("lang", 9)])
    assert out.total.first()["total"] == 4 and [r["id"] for r in out.hits.collect()] == ["3", "1", "4"]
    assert sorted((r["fieldname"], r["term"], r["count"]) for r in out.facets.collect()) == [("lang", "en", 2), ("tags", "a", 1), ("tags", "b", 2)]
    assert execute(data, cql.ALL, 2, 2).hits.count() == 0


@pytest.mark.parametrize("days, want", [(3, ("day", 3)), (12, ("month", 1)), (0, (None, 0))])
def test_multilevel(spark, days, want):
    rows = spark.createDataFrame([(f"2024-01-{i + 1:02}",) for i in range(days)], "d string")
    got = facets.multilevel(rows, [("day", F.col("d"), 10), ("month", F.substring("d", 1, 7), 5)]).collect()
    assert (got[0]["level"] if got else None, len(got)) == want


def test_parts(spark):
    records = spark.createDataFrame([("1", "a", "<a/>"), ("1", "b", "<b/>"), ("2", "a", "<a/>"), ("3", "b", "<b/>")], "identifier string, partname string, data string")
    assert sorted(r["identifier"] for r in parts.combine_parts(records, ["a", "b"]).collect()) == ["1"]
    got = {r["identifier"]: r["data"] for r in parts.combine_parts(records, ["b", "a"], optional=["b"], namespace="u").collect()}
    assert got == {"1": '<doc:document xmlns:doc="u"><doc:part name="b"><b/></doc:part><doc:part name="a"><a/></doc:part></doc:document>', "2": '<doc:document xmlns:doc="u"><doc:part name="a"><a/></doc:part></doc:document>'}
    envelopes = spark.createDataFrame([("1", "<r><x>1</x></r>"), ("2", "<r><x>1</x><x>2</x></r>"), ("", "<r/>"), ("4", "<r/>")], "identifier string, xml string")
    good, bad = parts.resolve_parts(envelopes, records, {"x": "/r/x/text()"}, {"a": "/r/a/text()"})
    assert sorted((r["identifier"], r["partname"], r["data"]) for r in good.collect()) == [("1", "a", "<a/>"), ("1", "x", "1")]
    assert {r["identifier"] for r in bad.collect()} == {"", "2", "4"}
    with pytest.raises(ValueError):
        parts.filter_parts(records)
    items = spark.createDataFrame([("a b", "<t>", None), (None, None, "d")], "id string, title string, description string")
    got = [r["item"] for r in parts.rss_items(items, "http://x/%(id)s", ["id"]).collect()]
    assert "<link>http://x/a%20b</link>" in got[0] and "&lt;t&gt;" in got[0] and "<link></link>" in got[1]
    messages = spark.createDataFrame([("add",), ("delete",)], "action string")
    assert [r["action"] for r in parts.rewrite_action(parts.filter_actions(messages, disallowed=["add"]), "delete", "remove").collect()] == ["remove"]


def test_fields(spark):
    xml = '<a xmlns="u"><b> x </b><!-- c --><b>y</b>tail<c k="v"><d>é</d></c><e> </e></a>'
    rows = spark.createDataFrame([("1", xml), ("2", "<bad"), ("3", None)], "identifier string, xml string")
    got = sorted((r["identifier"], r["pos"], r["name"], r["value"]) for r in fields.xml_to_fields(rows).collect())
    assert got[:3] == [("1", 0, "a.b", " x "), ("1", 1, "a.b", "y"), ("1", 2, "a.c.d", "é")] and got[3][2] == "error" and len(got) == 4
    assert [r["xml"] for r in fields.select_subtrees(rows.where("identifier = '1'"), "{u}c/{u}d").collect()] == ['<ns0:d xmlns:ns0="u">é</ns0:d>']
    lists = fields.xpath_fields(rows.where("identifier = '1'"), {"b": "//*[local-name()='b']/text()", "z": "//z/text()"}, as_list=True).collect()
    assert {r["name"]: r["value"] for r in lists} == {"b": [" x ", "y"], "z": []}


def update(action, identifier, data="<x/>"):
    return remote.update_envelope(identifier, action, data)


def test_updates(spark):
    bodies = [update("create", "1"), update("replace", "1", "<y/>"), update("delete", "2", None), update("nope", "3"), update("create", " "), "", "<bad", update("create", "4", "")]
    rows = ingest.parse_updates(spark.createDataFrame(list(enumerate(bodies)), "seq long, body string")).orderBy("seq").collect()
    assert [(r["identifier"], r["action"]) for r in rows[:3]] == [("1", "add"), ("1", "add"), ("2", "delete")]
    assert [r["diagnostic"] for r in rows[3:]] == [ingest.INVALID_COMPONENT] * 2 + [ingest.MISSING_BODY] + [ingest.INVALID_COMPONENT] * 2
    schema = "identifier string, partname string, data string, is_deleted boolean, seq long"
    stored = spark.createDataFrame([("1", "p", "d", False, 0), ("2", "p", "d", True, 0), ("3", "p", None, False, 0)], schema)
    incoming = spark.createDataFrame([("1", "p", "d", False, 1), ("1", "q", "d", False, 1), ("2", "p", None, True, 1), ("2", "p", "d", False, 1), ("3", "p", None, False, 1), ("3", "p", None, True, 1), ("9", "p", None, True, 1)], schema)
    got = sorted((r["identifier"], r["partname"], r["is_deleted"]) for r in ingest.only_changed(incoming, stored).collect())
    assert got == [("1", "q", False), ("2", "p", False), ("3", "p", True), ("9", "p", True)]


def test_upsert_table(spark, tmp_path):
    table = UpsertTable(spark, str(tmp_path), ["k"], ["seq"])
    batch = lambda *rows: spark.createDataFrame(rows, "k string, seq long, v string, is_deleted boolean")
    table.fold(batch(("a", 1, "x", False), ("b", 2, "y", False)), 0)
    table.fold(batch(("a", 3, "z", False), ("b", 4, None, True), ("c", 1, "w", False)), 1)
    table.fold(batch(("a", 9, "replayed", False)), 1)
    table.fold(batch(("c", 0, "late", False)), 2)
    assert sorted((r["k"], r["v"]) for r in table.live().collect()) == [("a", "z"), ("c", "w")] and len(table.versions()) <= 2


def test_timed_dictionary_and_cache():
    now = [0.0]
    d = state.TimedDictionary(10, most=2, clock=lambda: now[0])
    d["a"], d["b"] = 1, 2
    now[0] = 10
    assert d["a"] == 1 and len(d) == 2
    d.touch("a")
    d["c"] = 3
    assert list(d.entries) == ["a", "c"]
    now[0] = 20.1
    assert d.peek("a") == 1 and d.get("a") is None and "a" not in d and len(d) == 0
    calls = []
    cache = state.ResultCache(10, stale_on_error=True, backoff=5, clock=lambda: now[0])
    assert cache.get("k", lambda: calls.append(1) or "v") == "v" == cache.get("k", lambda: 1 / 0)
    now[0] += 11
    assert cache.get("k", lambda: calls.append(2) or 1 / 0) == "v" == cache.get("k", lambda: calls.append(3)) and calls == [1, 2]
    with pytest.raises(ZeroDivisionError):
        cache.get("other", lambda: 1 / 0)


def test_state_tables(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y"), ("b", 3, "z"), ("c", 11, "w")], "k string, at long, v string")
    assert sorted(map(tuple, state.live_keys(rows, "k", "at", F.lit(10), F.lit(5), "v").collect())) == [("a", 5, "y")]
    assert [r["k"] for r in state.newest_keys(rows, "k", "at", 2).orderBy(F.desc("at")).collect()] == ["c", "a"]
    pairs = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "key string, value long")
    assert [tuple(r) for r in state.duplicates(pairs, "value").collect()] == [(1, 2)] and state.reverse(pairs).columns == ["key", "value"]


@pytest.mark.parametrize("left, right", [([], []), ([1], []), ([], [1]), ([1, 2], [2, 3]), ([1, 1, None], [1]), ([3, 4], [1, 2])])
def test_sets(spark, left, right):
    a, b = (spark.createDataFrame([(x,) for x in xs], "key long") for xs in (left, right))
    have = lambda df: sorted(r[0] for r in df.collect())
    x, y = {i for i in left if i is not None}, set(right)
    assert have(sets.distinct_union([a, b])) == sorted(x | y) and have(sets.common(a, b)) == sorted(x & y) and have(sets.difference(a, b)) == sorted(x - y)
    assert have(sets.semi(a, b, "key")) == sorted(i for i in left if i in y)


def test_log_lines(spark, tmp_path):
    line = "2009-11-02T11:25:36Z 11.22.33.44 1.1K 1.300s 42hits /path query=arguments"
    path = tmp_path / "2009-11-02-query.log.gz"
    with gzip.open(path, "wt") as f:
        f.write(line + "\n\n1257161136 11.12.13.14 4.0K 12.340 0 /path key=value extra\n1257161136 - - - - /p\n")
    rows = logs.typed(logs.parse_lines(logs.read_log(spark, str(path)))).collect()
    assert tuple(rows[0])[1:] == (1257161136, "11.22.33.44", 1126, 1300, 42, "/path", "query=arguments") and rows[0]["file"] == path.name
    assert tuple(rows[1])[1:] == (1257161136, "11.12.13.14", 4096, 12340, 0, "/path", "key=value")
    assert tuple(rows[2])[1:] == (1257161136, "-", None, None, None, "/p", "")
    again = spark.createDataFrame(rows[:1]).select(logs.format_typed(None).alias("l")).first()["l"]
    assert again == line
    apache = logs.apache_line(F.lit(1468845136), F.lit("10.11.12.13"), F.lit("GET"), F.lit("/abc?d#e"), F.lit("200"), F.lit(None), F.lit(None), F.lit(None), F.lit("1.1"), F.lit("ValueError()"))
    assert spark.range(1).select(apache).first()[0] == '10.11.12.13 - - [18/Jul/2016:12:32:16 +0000] "GET /abc?d HTTP/1.1" 200 - "-" "-" Exception raised:\n    ValueError()'
    out = str(tmp_path / "daily")
    events = spark.createDataFrame([("2024-01-01", "a"), ("2024-01-02", "b")], "day string, line string")
    logs.write_daily(events, out, F.col("line"), F.col("day"))
    assert sorted(os.listdir(out))[-2:] == ["log_date=2024-01-01", "log_date=2024-01-02"] and spark.read.text(out).count() == 2


def test_config(spark, tmp_path):
    (tmp_path / "c").write_text("# c\na = 1\nb=x=y\na=2\nnothing\n")
    assert config.read_config(spark, str(tmp_path / "c")) == {"a": "2", "b": "x=y"}


def test_inbox(spark, tmp_path):
    inbox, done = tmp_path / "in", tmp_path / "done"
    inbox.mkdir()
    done.mkdir()
    (inbox / "old.xml").write_text("<old/>")
    got = []
    box = Inbox(spark, str(inbox), str(done), lambda df: got.extend(df.collect()))
    (inbox / "a.xml").write_text("<a/>")
    (inbox / "b.xml").write_text("<b")
    assert box.process() == 2 and [r["identifier"] for r in got] == ["a.xml"] and box.process() == 0
    assert sorted(os.listdir(done)) == ["a.xml", "b.xml", "b.xml.error"] and os.listdir(inbox) == ["old.xml"]
    assert Inbox(spark, str(inbox), str(done), lambda df: None, existing=True).process() == 1
    with pytest.raises(ValueError):
        Inbox(spark, str(tmp_path / "none"), str(done), lambda df: None)


class _Server(http.server.BaseHTTPRequestHandler):
    updates: list[str] = []

    def do_GET(self):
        from urllib.parse import parse_qs, urlsplit

        a = {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
        start, size = int(a.get("startRecord", 1)), int(a["maximumRecords"])
        stop = min(start + size, 8)
        records = "".join(f"<record><recordSchema>s</recordSchema><recordPacking>xml</recordPacking><recordIdentifier>id:{i}</recordIdentifier><recordData><r>{i}</r></recordData></record>" for i in range(start, stop))
        following = f"<nextRecordPosition>{stop}</nextRecordPosition>" if stop < 8 and size else ""
        self._send(gzip.compress(f"<searchRetrieveResponse><numberOfRecords>7</numberOfRecords><records>{records}</records>{following}</searchRetrieveResponse>".encode()), "gzip")

    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"])).decode()
        type(self).updates.append(body)
        self._send(f"<r><operationStatus>{'fail' if 'bad' in body else 'success'}</operationStatus></r>".encode(), None)

    def _send(self, body, encoding):
        self.send_response(200)
        if encoding:
            self.send_header("Content-Encoding", encoding)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def server():
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Server)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_address[1]}/sru"
    s.shutdown()


def test_remote(spark, server, tmp_path):
    assert [r[0] for r in remote.iterate_sru(server, "a", "s", maximum=3)] == [f"id:{i}" for i in range(1, 8)]
    remote.register(spark)
    rows = spark.read.format("sru").option("url", server).option("query", "a").option("recordSchema", "s").option("maximumRecords", 2).option("partitionSize", 3).load()
    assert sorted((r["identifier"], r["data"]) for r in rows.collect()) == [(f"id:{i}", f"<r>{i}</r>") for i in range(1, 8)]
    assert len(remote._SruReader({"url": server, "query": "a", "partitionSize": "3"}).partitions()) == 3
    remote.send_updates(spark.createDataFrame([("1", "replace", "<x/>")], "identifier string, action string, data string"), server)
    remote.post_update(server, remote.update_envelope("7", "delete"))
    with pytest.raises(remote.UpdateError):
        remote.post_update(server, remote.update_envelope("bad", "delete"))
    with pytest.raises(ValueError):
        remote.decompress(b"", "br")
    seen = []
    poll = spark.readStream.format("poll").option("url", server + "?maximumRecords=1").load()
    q = poll.writeStream.foreachBatch(lambda df, i: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "poll")).trigger(processingTime="1 second").start()
    for _ in range(60):
        if seen or q.exception():
            break
        q.awaitTermination(1)
    q.stop()
    assert seen and "numberOfRecords" in seen[0]["body"]


def test_token_patterns_agree_with_tokens(spark):
    import random

    from searchkit.plans.compile import token_pattern

    rng = random.Random(9)
    pieces = ["cat", "Cat,", "(dog)", "a", "-", "...", "'b'", "cat-dog", "dog ", "catch", "é", "CAT!", "\n", "　", " dog", "c.a.t", "!!x!!"]
    rows = [(i, " ".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))) for i in range(400)]
    frame = spark.createDataFrame(rows, "i int, x string").withColumn("t", text.tokens("x"))
    for words in (["cat"], ["cat", "dog"], ["dog", "catch"], ["cat-dog", "cat"], ["c.a.t"]):
        got = frame.withColumn("m", F.lower("x").rlike(token_pattern(words))).withColumn("p", F.lower("x").rlike(token_pattern(words, True))).collect()
        for r in got:
            t, n = r["t"], len(words)
            assert r["m"] == any(t[k : k + n] == words for k in range(len(t))), (r["x"], words)
            assert r["p"] == any(t[k : k + n - 1] == words[:-1] and t[k + n - 1].startswith(words[-1]) for k in range(len(t) - n + 1)), (r["x"], words)
