import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from searchkit.functions import text
from searchkit.operators import fields, requests, suggest
from searchkit.plans import render
from searchkit.plans.compile import Dataset
from searchkit.plans.service import SearchService

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def service(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    meta = docs.select(F.col("doc_id").cast("string").alias("identifier"), F.lit("meta").alias("partname"), F.concat(F.lit("<m><l>"), text.xml_escape("lang"), F.lit("</l></m>")).alias("data"))
    labels = spark.createDataFrame([("en", "English")], "term string, label string")
    data = Dataset(docs, "doc_id", text=("text",), default=("text",), aliases={"lang.uri": "lang"})
    return SearchService(data, meta, "meta", labels, suggest.vocabulary(docs, "text"), clock=lambda: 0.0)


def test_json(service, spark):
    out = service.json({"query": ["lang exact en"], "facet": ["lang.uri", "source:2"], "page-size": ["3"], "sort": ["-n_chars"]})
    want = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'")
    response = out["response"]
    assert response["total"] == want.count() and response["items"] == ["<m><l>en</l></m>"] * 3 and response["next"]["page"] == 2 and "previous" not in response
    assert response["facets"]["lang.uri"][0]["displayValue"] == "English" and len(response["facets"]["source"]) == 2
    assert service.json({"query": ["*"], "recordSchema": ["no"], "page-size": ["1"]})["response"]["items"][0]["error"] == "The recordSchema 'no' does not exist."
    assert service.json({"query": ["*"], "page-size": ["0"]})["response"]["total"] == 200
    assert service.json({})["error"] == {"type": "MissingArgument", "message": "Missing required argument: 'query'"}
    assert service.json({"query": ["nope=1"]})["error"]["type"] == "CqlError"
    json.loads(render.pretty(out))


def local(xml):
    out = {}
    for e in ET.fromstring(xml).iter():
        out.setdefault(e.tag.rpartition("}")[2], []).append(e.text)
    return out


def test_sru(service):
    base = {"version": ["1.2"], "operation": ["searchRetrieve"], "query": ["lang exact fr"]}
    got = local(service.sru(base | {"maximumRecords": ["2"], "x-term-drilldown": ["source:3,lang"], "x-suggestionsQuery": ["thea"]}))
    assert got["numberOfRecords"] == ["25"] and got["l"] == ["fr", "fr"] and got["nextRecordPosition"] == ["3"] and len(got["item"]) == 4 and got["suggestion"]
    assert local(service.sru(base | {"query": ["(a"]}))["uri"] == ["info://srw/diagnostics/1/48"] and local(service.sru(base | {"query": ["nope=1"]}))["uri"] == ["info://srw/diagnostics/1/48"]
    assert "serverInfo" in service.sru({}) and local(service.sru({"operation": ["x"]}))["uri"] == ["info://srw/diagnostics/1/4"]
    body = '<e:Envelope xmlns:e="http://schemas.xmlsoap.org/soap/envelope/"><e:Body><s:searchRetrieveRequest xmlns:s="s"><s:query>lang exact fr</s:query><s:maximumRecords>1</s:maximumRecords></s:searchRetrieveRequest></e:Body></e:Envelope>'
    assert local(service.srw(body))["numberOfRecords"] == ["25"] and "faultcode" in service.srw("<x")


def test_rss_and_completion(service):
    options = {"title": "T", "description": "D", "link": "L", "fields": {"title": ("meta", "/m/l/text()"), "description": ("meta", "/m/none/text()")}, "link_template": "http://h/%(title)s"}
    got = local(service.rss({"query": ["lang exact es"], "maximumRecords": ["2"], "sortKeys": ["n_chars,,1"]}, **options))
    assert got["title"] == ["T", "es", "es"] and got["link"][1:] == ["http://h/es"] * 2
    assert local(service.rss({}, **options))["title"] == ["ERROR T"]
    prefix, terms = json.loads(service.complete("Th"))
    assert prefix == "Th" and "the" in terms and json.loads(service.complete("t"))[1] == []


def test_small_pieces(spark):
    frame = spark.createDataFrame([("1", "n", "v", 0), ("1", "m", "w", 1)], "identifier string, name string, value string, pos int")
    assert [r["value"] for r in fields.filter_value(frame, lambda v: v == "w").collect()] == ["w"]
    assert frame.select(requests.first_of(F.array().cast("array<string>"), F.lit("d")).alias("x")).first()["x"] == "d"
    assert "success" in render.update_response() and "fail" in render.update_response("u", "d<", "m")
