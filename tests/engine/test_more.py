import datetime as dt
import os
import time
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from searchkit.operators import state
from searchkit.plans import render
from searchkit.plans.requests import SoapFault, SruError, parse_srw, parse_sru
from searchkit.plans.schedule import PeriodicCall, Schedule
from searchkit.sources import logs, xml
from searchkit.streaming.inbox import stream_folder

ENVELOPE = '<e:Envelope xmlns:e="http://schemas.xmlsoap.org/soap/envelope/"><e:Body><s:{} xmlns:s="http://www.loc.gov/zing/srw/">{}</s:{}></e:Body></e:Envelope>'


def test_srw():
    body = ENVELOPE.format("searchRetrieveRequest", "<s:query>a</s:query><s:startRecord>3</s:startRecord><s:version>1.2</s:version>", "searchRetrieveRequest")
    request = parse_sru(parse_srw(body))
    assert (request.text, request.start, request.version) == ("a", 2, "1.2")
    with pytest.raises(SoapFault):
        parse_srw("<bad")
    with pytest.raises(SoapFault):
        parse_srw("<Envelope/>")
    with pytest.raises(SruError) as e:
        parse_srw(ENVELOPE.format("explainRequest", "", "explainRequest"))
    assert (e.value.code, e.value.details) == (4, "explain")
    with pytest.raises(SruError) as e:
        parse_srw(ENVELOPE.format("searchRetrieveRequest", "<s:stylesheet>x</s:stylesheet>", "searchRetrieveRequest"))
    assert e.value.code == 8
    assert "faultcode" in render.soap_fault("SOAP:Client", "x<y") and ET.fromstring(render.soap_fault("SOAP:Client", "x<y")) is not None
    assert ET.fromstring(render.open_search("n", "d", "http://h/?q={searchTerms}&x=1", "http://h/c")) is not None and render.completions("te", ["term"]) == '["te", ["term"]]'


def at(hour, minute=0, second=0, day=1):
    return dt.datetime(2024, 1, day, hour, minute, second, tzinfo=dt.UTC).timestamp()  # 1 January 2024 is a Monday


@pytest.mark.parametrize("schedule, now, want", [
    (Schedule(period=7), at(1), 7), (Schedule(time_of_day="12:00"), at(11, 59), 60), (Schedule(time_of_day="12:00"), at(12), 86400), (Schedule(time_of_day="12:00"), at(12, 0, 1), 86399),
    (Schedule(time_of_day="12:00", day_of_week=1), at(12), 7 * 86400), (Schedule(time_of_day="12:00", day_of_week=1), at(11), 3600), (Schedule(time_of_day="11:00", day_of_week=2), at(12), 23 * 3600), (Schedule(time_of_day="12:00", day_of_week=7), at(12), 6 * 86400),
    (Schedule(epoch=at(12)), at(11), 3600), (Schedule(epoch=at(12)), at(13), 365 * 86400), (Schedule(epoch=0), at(1), 365 * 86400),
])
def test_schedule(schedule, now, want):
    assert schedule.seconds(now) == want


@pytest.mark.parametrize("given", [{}, {"period": 1, "epoch": 2}, {"day_of_week": 1}, {"time_of_day": "1:00", "day_of_week": 8}, {"period": 1, "day_of_week": 1}])
def test_no_schedule(given):
    with pytest.raises(ValueError):
        Schedule(**given)


def test_periodic_call():
    seen = []

    def call():
        seen.append(1)
        if len(seen) == 2:
            raise KeyError("x")

    p = PeriodicCall(call, Schedule(period=0.01), on_error=Schedule(period=0.01), log=lambda _: None)
    p.resume()
    until = time.time() + 5
    while len(seen) < 4 and time.time() < until:
        time.sleep(0.01)
    p.pause()
    time.sleep(0.1)
    n = len(seen)
    time.sleep(0.1)
    assert len(seen) == n >= 4 and p.state["errors"] == 1 and p.state["last_error"] == "KeyError: 'x'"


def test_saved_dictionary(tmp_path):
    now = [0.0]
    d = state.SavedTimedDictionary(str(tmp_path / "d"), 10, clock=lambda: now[0])
    d["a"], d["b"] = [1], {"x": 2}
    d.pop("b")
    now[0] = 5
    again = state.SavedTimedDictionary(str(tmp_path / "d"), 10, clock=lambda: now[0])
    assert again["a"] == [1] and "b" not in again
    now[0] = 11
    assert again.get("a") is None


def test_rotation(spark, tmp_path):
    days = spark.createDataFrame([(f"2024-01-{i:02}", "x") for i in range(1, 6)], "day string, line string")
    logs.write_daily(days, str(tmp_path / "daily"), F.col("line"), F.col("day"))
    assert logs.rotate(spark, str(tmp_path / "daily"), 2) == ["2024-01-01", "2024-01-02", "2024-01-03"] and logs.log_days(spark, str(tmp_path / "daily")) == ["2024-01-04", "2024-01-05"]
    for _ in range(5):
        logs.persist(days.coalesce(1), str(tmp_path / "log"), F.col("line"), max_records=100)
    assert logs.keep_newest_files(spark, str(tmp_path / "log"), 3) == 2 and spark.read.text(str(tmp_path / "log")).count() == 15
    assert logs.keep_newest_files(spark, str(tmp_path / "log"), None) == 0
    with pytest.raises(ValueError):
        logs.keep_newest_files(spark, str(tmp_path / "log"), 2)
    assert logs.with_constants(days, {"host": "h"}).first()["host"] == "h"


def test_xml(spark, tmp_path):
    (tmp_path / "in.xml").write_text('<all><r id="1"><t>a</t><t>b</t></r><r id="2"><t>c</t></r></all>')
    rows = xml.read(spark, str(tmp_path / "in.xml"), "r", "_id long, t array<string>").collect()
    assert [(r["_id"], r["t"]) for r in rows] == [(1, ["a", "b"]), (2, ["c"])]
    assert xml.read_whole(spark, str(tmp_path)).first()["identifier"] == "in.xml"
    frame = spark.createDataFrame([("<r><t>é</t></r>",), ("<r><t>",), (None,)], "x string")
    assert [r[0] and r[0]["t"] for r in frame.select(xml.parsed("x", "t string")).collect()] == ["é", None, None]
    assert "<t>é</t>" in frame.limit(1).select(xml.printed(xml.parsed("x", "t string"), "r").alias("y")).first()["y"]
    xsd = '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="r"><xs:complexType><xs:sequence><xs:element name="t" type="xs:string"/></xs:sequence></xs:complexType></xs:element></xs:schema>'
    more = spark.createDataFrame([("<r><t>é</t></r>",), ("<r><t>",), (None,), ("<r><u/></r>",)], "x string")
    assert [r["valid"] for r in xml.validate(more, "x", xsd).collect()] == [True, False, False, False]


def test_folder_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text("<a>\n</a>")
    got = []
    q = stream_folder(spark, str(tmp_path / "in")).writeStream.foreachBatch(lambda df, i: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert [(r["identifier"], r["data"]) for r in got] == [("a.xml", "<a>\n</a>")] and os.listdir(tmp_path / "in") == ["a.xml"]


def test_packets(spark, tmp_path):
    import socket

    from searchkit.sources import remote

    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        port = s.getsockname()[1]
    remote.register(spark)
    got = []
    stream = spark.readStream.format("packets").option("port", port).option("wait", 0.3).load()
    q = stream.writeStream.foreachBatch(lambda df, i: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        for _ in range(100):
            s.sendto("päcket".encode(), ("127.0.0.1", port))
            if got or q.exception():
                break
            q.awaitTermination(0.5)
    q.stop()
    assert q.exception() is None and got[0]["data"] == "päcket" and got[0]["host"] == "127.0.0.1"
