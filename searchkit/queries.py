"""Every query of the search engine over the sample tables, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchkit.functions import net, numeric, text
from searchkit.operators import facets, fields, ingest, parts, requests, sets, state, suggest
from searchkit.plans import cql
from searchkit.plans.compile import Dataset, compile_query
from searchkit.plans.engine import Response, execute, paging, search, search_collapsed
from searchkit.plans.requests import Facet, SortKey, parse_drilldown_query, parse_rss, parse_search, parse_srw, parse_sru, read_requests
from searchkit.plans.webquery import WebQuery, read_queries
from searchkit.session import shared_folder
from searchkit.sources import config, logs
from searchkit.sources import xml as xmlsource
from searchkit.streaming.upsert import UpsertTable, upsert_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> Dataset:
    return Dataset(table(spark, sf_dir, "documents"), "doc_id", text=("text",), default=("text",))


def orders(spark: SparkSession, sf_dir: str) -> Dataset:
    return Dataset(table(spark, sf_dir, "orders"), "o_orderkey", aliases={"status": "o_orderstatus", "priority": "o_orderpriority", "price": "o_totalprice"})


def run(data: Dataset, text_query: str, **options) -> Response:
    return execute(data, cql.parse(text_query), **options)


#: A schema whose key has one digit.
NATION_XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="nation"><xs:complexType><xs:sequence>
<xs:element name="key"><xs:simpleType><xs:restriction base="xs:string"><xs:pattern value="[0-9]"/></xs:restriction></xs:simpleType></xs:element>
<xs:element name="name" type="xs:string"/></xs:sequence></xs:complexType></xs:element></xs:schema>"""

_PUNCT = text.PUNCTUATION.replace("'", "''")
#: SQL for the tokens of a text.
TEXT_TOKENS = f"list_filter(list_transform(regexp_split_to_array(text, '\\s+'), lambda w: lower(trim(w, '{_PUNCT}'))), lambda t: length(t) > 1)"

# Search.


@query("search_page", f"""
SELECT doc_id, n_chars FROM documents
WHERE lang = 'en' AND list_contains({TEXT_TOKENS}, 'the') AND source IS DISTINCT FROM 'src0'
ORDER BY n_chars DESC, doc_id LIMIT 10""")
def search_page(spark, d):
    found = run(documents(spark, d), "lang exact en AND text=the NOT source exact src0", sort=[SortKey("n_chars", True)], stop=10)
    return found.hits.select("doc_id", "n_chars")


@query("search_term", f"SELECT doc_id FROM documents WHERE list_contains({TEXT_TOKENS}, 'the')")
def search_term(spark, d):
    return run(documents(spark, d), "text=the").matched.select("doc_id")


@query("search_phrase", f"""
SELECT doc_id FROM documents WHERE contains(chr(31) || array_to_string({TEXT_TOKENS}, chr(31)) || chr(31), chr(31) || 'of' || chr(31) || 'the' || chr(31))""")
def search_phrase(spark, d):
    return run(documents(spark, d), 'text="of the"').matched.select("doc_id")


@query("search_prefix", f"SELECT doc_id FROM documents WHERE len(list_filter({TEXT_TOKENS}, lambda t: starts_with(t, 'thin'))) > 0")
def search_prefix(spark, d):
    return run(documents(spark, d), "text=thin*").matched.select("doc_id")


@query("search_exact", "SELECT doc_id FROM documents WHERE lang = 'fr'")
def search_exact(spark, d):
    return run(documents(spark, d), "lang exact fr").matched.select("doc_id")


@query("search_compare", "SELECT p_partkey FROM part WHERE p_size >= 40 AND p_retailprice < 1500 AND NOT p_size = 45")
def search_compare(spark, d):
    return run(Dataset(table(spark, d, "part"), "p_partkey"), "p_size >= 40 AND p_retailprice < 1500 NOT p_size = 45").matched.select("p_partkey")


@query("search_boolean", "SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND source IS DISTINCT FROM 'src3'")
def search_boolean(spark, d):
    return run(documents(spark, d), "(lang exact en OR lang exact de) NOT source exact src3").matched.select("doc_id")


@query("search_match_all", "SELECT count(*) AS total FROM documents")
def search_match_all(spark, d):
    return run(documents(spark, d), "*").total


@query("search_plusminus", f"SELECT doc_id FROM documents WHERE list_contains({TEXT_TOKENS}, 'the') AND NOT list_contains({TEXT_TOKENS}, 'of')")
def search_plusminus(spark, d):
    return execute(documents(spark, d), WebQuery("+the -of", "*").tree).matched.select("doc_id")


@query("search_facet_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def search_facet_filter(spark, d):
    request = parse_search({"query": ["*"], "facet-filter": ["status=F"]})
    return search(orders(spark, d), request).matched.select("o_orderkey")


@query("search_collapsed", "SELECT count(DISTINCT text) AS total, count(text) AS total_with_duplicates FROM documents WHERE lang = 'en'")
def search_collapsed_totals(spark, d):
    return search_collapsed(documents(spark, d), cql.parse("lang exact en"), "text")[1]


@query("drilldown_query", "SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
def drilldown_query(spark, d):
    filters = parse_drilldown_query(["status=O", "priority exact 1-URGENT"])
    return execute(orders(spark, d), cql.and_filters(cql.ALL, filters)).total


@query("context_alias", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def context_alias(spark, d):
    aliases = cql.ContextSets({"ord": cql.ContextSets.read("state o_orderstatus # physical\nstate o_other\n")})
    tree = cql.rename_indexes(cql.parse("ord.state exact P"), aliases.lookup)
    return execute(orders(spark, d), tree).matched.select("o_orderkey")


@query("exact_untokenized", "SELECT doc_id FROM documents WHERE source = 'src1'")
def exact_untokenized(spark, d):
    docs = table(spark, d, "documents").withColumnRenamed("source", "untokenized.source")
    tree = cql.exact_to_untokenized(cql.parse("source == src1"), ["untokenized.*"], "untokenized.")
    data = Dataset(docs.toDF(*[c.replace(".", "_") for c in docs.columns]), "doc_id", aliases={"untokenized.source": "untokenized_source"})
    return execute(data, tree).matched.select("doc_id")


@query("clause_conversion", "SELECT doc_id FROM documents WHERE lang = 'fr' OR lang = 'es'")
def clause_conversion(spark, d):
    rule = cql.modify_terms(lambda index, relation, term: index == "language", str.lower, lambda _: "lang")
    return execute(documents(spark, d), cql.convert(cql.parse("language exact FR OR language exact ES"), [rule])).matched.select("doc_id")


# Sort and page.


@query("sort_multi_key", "SELECT p_partkey, p_brand, p_retailprice FROM part ORDER BY p_brand, p_retailprice DESC, p_partkey LIMIT 25")
def sort_multi_key(spark, d):
    data = Dataset(table(spark, d, "part"), "p_partkey")
    request = parse_search({"query": ["*"], "sort": ["p_brand,-p_retailprice"], "page-size": ["25"]})
    return search(data, request).hits.select("p_partkey", "p_brand", "p_retailprice")


@query("page_slice", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def page_slice(spark, d):
    request = parse_search({"query": ["*"], "sort": ["-price"], "page": ["3"], "page-size": ["20"]})
    return search(orders(spark, d), request).hits.select("o_orderkey", "o_totalprice")


@query("page_totals", """
SELECT count(*) AS total, count(*) > 60 AS has_next, true AS has_previous,
       CASE WHEN least(20, count(*) - 40) > 0 AND 40 + least(20, count(*) - 40) < count(*) THEN 40 + least(20, count(*) - 40) + 1 END AS next_position
FROM orders WHERE o_orderstatus = 'F'""")
def page_totals(spark, d):
    return paging(run(orders(spark, d), "status exact F").total, 40, 60)


# Facets.


@query("facet_terms", "SELECT source AS term, count(*) AS count FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def facet_terms(spark, d):
    return run(documents(spark, d), "*", facets=[Facet("source", 5)]).facets.select("term", "count")


@query("facet_by_index", "SELECT o_orderpriority AS term, count(*) AS count FROM orders GROUP BY 1 ORDER BY 1 LIMIT 3")
def facet_by_index(spark, d):
    return run(orders(spark, d), "*", facets=[Facet("priority", 3, "index")]).facets.select("term", "count")


@query("facet_multi", """
SELECT 'lang' AS fieldname, lang AS term, count(*) AS count FROM documents WHERE n_chars > 500 GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'source', source, count(*) FROM documents WHERE n_chars > 500 GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 4)""")
def facet_multi(spark, d):
    found = run(documents(spark, d), "n_chars > 500", facets=[Facet("lang"), Facet("source", 4), Facet("lang", 1)])
    return found.facets.select("fieldname", "term", "count")


@query("facet_multivalued", f"""
SELECT term, count(DISTINCT doc_id) AS count FROM (SELECT doc_id, unnest({TEXT_TOKENS}) AS term FROM documents WHERE lang = 'en')
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def facet_multivalued(spark, d):
    matched = run(documents(spark, d), "lang exact en").matched
    counts = facets.term_counts(matched, {"words": text.tokens("text")})
    return facets.top_terms(counts, [Facet("words", 15)]).select("term", "count")


@query("facet_pivot", """
SELECT o_orderstatus AS term1, sum(n) OVER (PARTITION BY o_orderstatus)::BIGINT AS count1, o_orderpriority AS term2, n AS count2
FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY n DESC, o_orderpriority) <= 3""")
def facet_pivot(spark, d):
    return facets.pivot_facet(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], [10, 3]).select("term1", "count1", "term2", "count2")


@query("facet_rollup", """
SELECT o_orderstatus, o_orderpriority, count(*) AS count, (2 - grouping(o_orderstatus) - grouping(o_orderpriority))::INT AS level
FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")
def facet_rollup(spark, d):
    return facets.rollup_facet(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("field_drilldown", f"""
SELECT 'text' AS field, count(*) FILTER (list_contains({TEXT_TOKENS}, 'en')) AS count FROM documents
UNION ALL SELECT 'lang', count(*) FILTER (lang = 'en') FROM documents UNION ALL SELECT 'source', count(*) FILTER (source = 'en') FROM documents""")
def field_drilldown(spark, d):
    data = documents(spark, d)
    return facets.field_counts(data.frame, {f: compile_query(cql.Clause("en", f, "="), data) for f in ("text", "lang", "source")})


_LEVELS = "(SELECT {} AS term, count(*) AS count FROM orders GROUP BY 1)"


@query("multilevel_drilldown", f"""
WITH days AS {_LEVELS.format("strftime(o_orderdate, '%Y-%m-%d')")}, months AS {_LEVELS.format("strftime(o_orderdate, '%Y-%m')")}, years AS {_LEVELS.format("strftime(o_orderdate, '%Y')")},
pick AS (SELECT CASE WHEN (SELECT count(*) FROM days) < 10 THEN 'day' WHEN (SELECT count(*) FROM months) < 50 THEN 'month' ELSE 'year' END AS level)
SELECT level, term, count FROM pick, (SELECT 'day' AS l, * FROM days UNION ALL SELECT 'month', * FROM months UNION ALL SELECT 'year', * FROM years) WHERE l = level""")
def multilevel_drilldown(spark, d):
    own = table(spark, d, "orders")
    form = lambda f: F.date_format("o_orderdate", f)
    return facets.multilevel(own, [("day", form("yyyy-MM-dd"), 10), ("month", form("yyyy-MM"), 50), ("year", form("yyyy"), 50)]).select("level", "term", "count")


@query("facet_translate", """
SELECT 'state' AS fieldname, o_orderstatus AS term, count(*) AS count FROM orders GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'condition', o_orderstatus, count(*) FROM orders GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 1)""")
def facet_translate(spark, d):
    names = {"state": "o_orderstatus", "condition": "o_orderstatus"}
    return facets.term_facets(table(spark, d, "orders"), [Facet("state"), Facet("condition", 1)], names).select("fieldname", "term", "count")


@query("facet_labels", """
SELECT c_nationkey::VARCHAR AS term, count(*) AS count, any_value(n_name) AS display_term FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def facet_labels(spark, d):
    top = facets.term_facets(table(spark, d, "customer"), [Facet("c_nationkey")])
    labels = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("term"), F.col("n_name").alias("label"))
    return facets.label_terms(top, labels).select("term", "count", "display_term")


@query("collapse_duplicates", "SELECT min(doc_id) AS doc_id, count(*) AS duplicate_count FROM documents GROUP BY text")
def collapse_duplicates(spark, d):
    return facets.collapse(table(spark, d, "documents"), "text", [], "doc_id").select("doc_id", "duplicate_count")


# Records and parts.


def _label_parts(spark, d) -> DataFrame:
    labels = table(spark, d, "labels")
    one = lambda name: labels.select(F.col("doc_id").alias("identifier"), F.lit(name).alias("partname"), F.concat(F.lit(f"<{name}>"), F.col(name).cast("string"), F.lit(f"</{name}>")).alias("data"))
    return one("quality").unionByName(one("toxic"))


@query("hits_items", """
WITH hits AS (SELECT doc_id FROM documents WHERE lang = 'de' ORDER BY n_chars DESC, doc_id LIMIT 30)
SELECT doc_id, '<quality>' || quality || '</quality>' AS data, CASE WHEN quality IS NULL THEN 'The recordSchema ''quality'' does not exist.' END AS error
FROM hits LEFT JOIN labels USING (doc_id)""")
def hits_items(spark, d):
    found = run(documents(spark, d), "lang exact de", sort=[SortKey("n_chars", True)], stop=30)
    return parts.attach_items(found.hits, _label_parts(spark, d), "quality", "doc_id").select("doc_id", "data", "error")


@query("extra_schemas", """
WITH hits AS (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50)
SELECT doc_id, '<quality>' || quality || '</quality>' AS quality, '<toxic>' || toxic || '</toxic>' AS toxic FROM hits LEFT JOIN labels USING (doc_id)""")
def extra_schemas(spark, d):
    hits = run(documents(spark, d), "*", stop=50).hits.select("doc_id")
    return parts.attach_schemas(hits, _label_parts(spark, d), ["quality", "toxic"], "doc_id").select("doc_id", "quality", "toxic")


def _doc_parts(spark, d) -> DataFrame:
    """A part of every document, and one for each label."""
    docs = table(spark, d, "documents")
    meta = docs.select(F.col("doc_id").cast("string").alias("identifier"), F.lit("meta").alias("partname"), _meta().alias("data"))
    return meta.unionByName(_label_parts(spark, d).withColumn("identifier", F.col("identifier").cast("string")))


def _meta():
    return F.concat(F.lit("<meta><lang>"), text.xml_escape("lang"), F.lit("</lang><source>"), text.xml_escape("source"), F.lit("</source></meta>"))


_META = "'<meta><lang>' || lang || '</lang><source>' || source || '</source></meta>'"


@query("combine_parts", f"""
SELECT doc_id::VARCHAR AS identifier, '<doc:document xmlns:doc="urn:searchkit:document"><doc:part name="meta">' || {_META} || '</doc:part>'
  || coalesce('<doc:part name="quality"><quality>' || quality || '</quality></doc:part>', '') || '</doc:document>' AS data
FROM documents LEFT JOIN labels USING (doc_id)""")
def combine_parts(spark, d):
    return parts.combine_parts(_doc_parts(spark, d), ["meta", "quality"], optional=["quality"])


@query("part_filter", "SELECT doc_id::VARCHAR AS identifier, 'label' AS partname, '<toxic>' || toxic || '</toxic>' AS data FROM labels")
def part_filter(spark, d):
    return parts.rewrite_partname(parts.filter_parts(_doc_parts(spark, d), excluded=["meta", "quality"]), "label").select("identifier", "partname", "data")


def _resolve(spark, d, should, could):
    envelopes = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("identifier"), _meta().alias("xml"))
    stored = _label_parts(spark, d).withColumn("identifier", F.col("identifier").cast("string"))
    return parts.resolve_parts(envelopes, stored, should, could)


@query("venturi_coalesce", """
SELECT doc_id::VARCHAR AS identifier, 'lang' AS partname, lang AS data FROM documents
UNION ALL SELECT doc_id::VARCHAR, 'quality', '<quality>' || quality || '</quality>' FROM documents JOIN labels USING (doc_id)""")
def venturi_coalesce(spark, d):
    return _resolve(spark, d, {"lang": "/meta/lang/text()"}, {"quality": "/meta/quality/text()"})[0]


@query("venturi_errors", "SELECT doc_id::VARCHAR AS identifier, 'Expected ''quality''' AS error FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def venturi_errors(spark, d):
    return _resolve(spark, d, {"quality": "/meta/quality/text()"}, {"lang": "/meta/lang/text()"})[1]


@query("compose_record", """
SELECT doc_id, CASE WHEN quality IS NOT NULL THEN '<doc><lang>' || lang || '</lang><quality>' || quality || '</quality></doc>' ELSE '' END AS record
FROM documents LEFT JOIN labels USING (doc_id)""")
def compose_record(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return parts.compose(rows, "<doc><lang>%(lang)s</lang><quality>%(quality)s</quality></doc>", ["lang", "quality"]).select("doc_id", "record")


@query("compose_parts", """
SELECT doc_id::VARCHAR AS identifier, CASE WHEN toxic IS NOT NULL THEN '<d>' || source || ': ' || toxic || '</d>' ELSE '' END AS record FROM documents LEFT JOIN labels USING (doc_id)""")
def compose_parts(spark, d):
    rows = parts.fields_of_parts(_doc_parts(spark, d), {"source": ("meta", "/meta/source/text()"), "toxic": ("toxic", "/toxic/text()")})
    return parts.compose(rows, "<d>%(source)s: %(toxic)s</d>", ["source", "toxic"]).select("identifier", "record")


@query("rss_items", """
SELECT page_id, '<item>' || chr(10) || '    <title>' || page_id || '</title>' || chr(10) || '    <description>' || replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</description>' || chr(10)
  || '    <link>http://example.org/?id=' || page_id || '</link>' || chr(10) || '    <guid>http://example.org/?id=' || page_id || '</guid>' || chr(10) || '</item>' AS item FROM pages""")
def rss_items(spark, d):
    return parts.rss_items(table(spark, d, "pages"), "http://example.org/?id=%(page_id)s", ["page_id"], title="page_id", description="url").select("page_id", "item")


# Fields.


def _part_fields(spark, d) -> DataFrame:
    return fields.wide_to_fields(table(spark, d, "part"), "p_partkey", ["p_name", "p_brand", "p_type"])


@query("fieldlet_chain", """
SELECT p_partkey::VARCHAR AS identifier, 'part.brand' AS name, upper(p_brand) AS value FROM part WHERE p_brand <> 'Brand#11'
UNION ALL SELECT p_partkey::VARCHAR, 'kind', 'part' FROM part""")
def fieldlet_chain(spark, d):
    own = _part_fields(spark, d)
    brand = lambda f: fields.transform(fields.rename(fields.filter_name(f, lambda n: n == "p_brand"), lambda n: F.lit("part.brand")), lambda v: F.when(v != "Brand#11", F.upper(v)))
    return fields.fan_out(own, [brand, lambda f: fields.add_field(f, "kind", "part")]).select("identifier", "name", "value")


@query("convert_column", "SELECT p_partkey, length(p_name) AS name_length FROM part")
def convert_column(spark, d):
    return fields.convert(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "name_length", lambda c: F.length(c).cast("long"))


@query("tokenize", f"SELECT doc_id, unnest(t) AS token, unnest(range(len(t)))::BIGINT AS pos FROM (SELECT doc_id, {TEXT_TOKENS} AS t FROM documents)")
def tokenize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.tokens("text")).alias("pos", "token")).select("doc_id", "token", F.col("pos").cast("long").alias("pos"))


@query("xml_roundtrip", """
SELECT n_nationkey::VARCHAR AS identifier, 'record.nation.name' AS name, n_name AS value FROM nation
UNION ALL SELECT n_nationkey::VARCHAR, 'record.nation.region', n_regionkey::VARCHAR FROM nation""")
def xml_roundtrip(spark, d):
    own = fields.wide_to_fields(table(spark, d, "nation"), "n_nationkey", ["n_name", "n_regionkey"])
    named = fields.rename(own, lambda n: F.when(n == "n_name", "nation.name").otherwise("nation.region"))
    return fields.xml_to_fields(fields.fields_to_xml(named, tag="record")).select("identifier", "name", "value")


@query("fields_to_xml", """
SELECT n_nationkey::VARCHAR AS identifier, '<fields><field name="n_name">' || n_name || '</field><field name="n_regionkey">' || n_regionkey || '</field></fields>' AS xml FROM nation""")
def fields_to_xml(spark, d):
    return fields.fields_to_xml(fields.wide_to_fields(table(spark, d, "nation"), "n_nationkey", ["n_name", "n_regionkey"]), tag="fields", flat=True)


@query("xpath_fields", """
SELECT n_nationkey::VARCHAR AS identifier, 'title' AS name, n_name AS value FROM nation UNION ALL SELECT n_nationkey::VARCHAR, 'region', n_regionkey::VARCHAR FROM nation""")
def xpath_fields(spark, d):
    nation = table(spark, d, "nation")
    xml = F.concat(F.lit('<n region="'), F.col("n_regionkey").cast("string"), F.lit('"><t>'), text.xml_escape("n_name"), F.lit("</t></n>"))
    return fields.xpath_fields(nation.select(F.col("n_nationkey").alias("identifier"), xml.alias("xml")), {"title": "/n/t/text()", "region": "/n/@region"}).select("identifier", "name", "value")


# Updates and state.


def _event_updates(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("identifier"), "ts", "event_id", F.col("event_type").alias("data"), (F.col("event_type") == "error").alias("is_deleted"))


_LATEST = """
SELECT user_id AS identifier, event_id, event_type AS data FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND event_type <> 'error'"""


@query("upsert_latest", _LATEST)
def upsert_latest(spark, d):
    return ingest.apply_updates(None, _event_updates(table(spark, d, "events")), ["identifier"], ["ts", "event_id"]).select("identifier", "event_id", "data")


@query("stream_upsert", _LATEST)
def stream_upsert(spark, d):
    folder = f"{shared_folder(spark)}/upsert-{uuid.uuid4().hex}"
    source = f"{d}/events.parquet"
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d) if not _is_folder(spark, source) else spark.readStream.schema(schema).parquet(source)
    kept = UpsertTable(spark, folder, ["identifier"], ["ts", "event_id"])
    upsert_stream(_event_updates(stream), kept, f"{folder}-progress")
    return kept.live().select("identifier", "event_id", "data")


def _is_folder(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


_HALF = "2024-01-16 00:00:00"


@query("only_changed", f"""
WITH stored AS (
  SELECT user_id, event_type FROM events WHERE ts < TIMESTAMP '{_HALF}' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT event_id FROM events e LEFT JOIN stored s USING (user_id) WHERE ts >= TIMESTAMP '{_HALF}' AND e.event_type IS DISTINCT FROM s.event_type""")
def only_changed(spark, d):
    updates = _event_updates(table(spark, d, "events"))
    stored = ingest.apply_updates(None, updates.where(f"ts < timestamp_ntz'{_HALF}'"), ["identifier"], ["ts", "event_id"], keep_tombstones=True)
    return ingest.only_changed(updates.where(f"ts >= timestamp_ntz'{_HALF}'"), stored, keys=["identifier"]).select("event_id")


@query("parse_updates", """
SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN user_id::VARCHAR END AS identifier, CASE WHEN event_id % 5 <> 0 THEN CASE WHEN event_type = 'error' THEN 'delete' ELSE 'add' END END AS action,
       CASE WHEN event_id % 5 <> 0 AND event_type <> 'error' THEN '<event>' || event_type || '</event>' END AS data,
       CASE WHEN event_id % 5 = 0 THEN 'recordIdentifier is mandatory.' END AS details FROM events""")
def parse_updates(spark, d):
    events = table(spark, d, "events")
    removed = F.col("event_type") == "error"
    body = F.concat(
        F.lit('<u:updateRequest xmlns:u="info:lc/xmlns/update-v1" xmlns:s="http://www.loc.gov/zing/srw/"><u:action>info:srw/action/1/'), F.when(removed, "delete").otherwise("replace"),
        F.lit("</u:action><u:recordIdentifier>"), F.when(F.col("event_id") % 5 != 0, F.col("user_id").cast("string")).otherwise(" "), F.lit("</u:recordIdentifier>"),
        F.when(removed, "").otherwise(F.concat(F.lit("<s:record><s:recordSchema>e</s:recordSchema><s:recordData><event>"), F.col("event_type"), F.lit("</event></s:recordData></s:record>"))),
        F.lit("</u:updateRequest>"),
    )
    return ingest.parse_updates(events.select("event_id", body.alias("body")), keep=["event_id"]).select("event_id", "identifier", "action", "data", "details")


_NOW = "2024-01-20 00:00:00"


@query("ttl_expiry", f"""
SELECT user_id, max(ts) AS ts FROM events WHERE ts <= TIMESTAMP '{_NOW}' GROUP BY 1 HAVING max(ts) >= TIMESTAMP '{_NOW}' - INTERVAL 6 HOUR""")
def ttl_expiry(spark, d):
    return state.live_keys(table(spark, d, "events"), "user_id", "ts", F.lit(_NOW).cast("timestamp_ntz"), F.expr("interval 6 hours")).select("user_id", "ts")


@query("lru_keys", "SELECT user_id, max(ts) AS ts FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def lru_keys(spark, d):
    return state.newest_keys(table(spark, d, "events"), "user_id", "ts", 20)


@query("bijection_check", "SELECT n_regionkey, count(*) AS keys FROM nation GROUP BY 1 HAVING count(*) > 1")
def bijection_check(spark, d):
    return state.duplicates(table(spark, d, "nation"), "n_regionkey")


# Sets.


def _keys(spark, d) -> tuple[DataFrame, DataFrame]:
    own = table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("key"))
    return own, table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("key"))


_LEFT, _RIGHT = "SELECT o_custkey AS key FROM orders WHERE o_totalprice > 200000", "SELECT c_custkey AS key FROM customer WHERE c_acctbal > 5000"


@query("set_or", f"{_LEFT} UNION {_RIGHT}")
def set_or(spark, d):
    return sets.distinct_union(_keys(spark, d))


@query("set_and", f"{_LEFT} INTERSECT {_RIGHT}")
def set_and(spark, d):
    return sets.common(*_keys(spark, d))


@query("set_not", f"{_LEFT} EXCEPT {_RIGHT}")
def set_not(spark, d):
    return sets.difference(*_keys(spark, d))


@query("set_semi", f"SELECT o_orderkey, o_custkey AS key FROM orders WHERE o_custkey IN ({_RIGHT})")
def set_semi(spark, d):
    return sets.semi(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("key")), _keys(spark, d)[1], "key").select("o_orderkey", "key")


# Logs.


def _log_rows(events: DataFrame) -> DataFrame:
    n = F.col("event_id")
    return events.select(
        "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("timestamp"), F.concat(F.lit("10.0."), F.floor(F.col("user_id") / 256).cast("string"), F.lit("."), (F.col("user_id") % 256).cast("string")).alias("ip_address"),
        F.when(n % 7 != 0, (n % 1000) / F.lit(10.0)).alias("size"), F.when(n % 11 != 0, (n % 5000) / F.lit(1000.0)).alias("duration"), F.when(n % 3 != 0, n % 100).alias("hits"),
        F.concat(F.lit("/"), F.col("event_type")).alias("path"), F.concat(F.lit("id="), n.cast("string")).alias("arguments"),
    )


def _log_lines(events: DataFrame) -> DataFrame:
    line = logs.format_line(*[F.col(c) for c in ("timestamp", "ip_address", "size", "duration", "hits", "path", "arguments")])
    return _log_rows(events).select("event_id", line.alias("value"))


_ADDRESS = "'10.0.' || user_id // 256 || '.' || user_id % 256"


@query("log_format", f"""
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ' ' || {_ADDRESS} || ' ' || CASE WHEN event_id % 7 <> 0 THEN printf('%.1fK', (event_id % 1000) / 10.0) ELSE '-' END || ' '
  || CASE WHEN event_id % 11 <> 0 THEN printf('%.3fs', (event_id % 5000) / 1000.0) ELSE '-' END || ' ' || CASE WHEN event_id % 3 <> 0 THEN event_id % 100 || 'hits' ELSE '-' END
  || ' /' || event_type || ' id=' || event_id AS value FROM events""")
def log_format(spark, d):
    return _log_lines(table(spark, d, "events"))


@query("log_parse", f"""
SELECT event_id, floor(epoch(ts))::BIGINT AS timestamp, {_ADDRESS} AS ip_address, CASE WHEN event_id % 7 <> 0 THEN floor((event_id % 1000) / 10.0::DOUBLE * 1024)::BIGINT END AS size,
  CASE WHEN event_id % 11 <> 0 THEN floor((event_id % 5000) / 1000.0::DOUBLE * 1000)::BIGINT END AS duration, CASE WHEN event_id % 3 <> 0 THEN event_id % 100 END AS hits,
  '/' || event_type AS path, 'id=' || event_id AS arguments FROM events""")
def log_parse(spark, d):
    return logs.typed(logs.parse_lines(_log_lines(table(spark, d, "events"))))


@query("log_apache", f"""
SELECT event_id, {_ADDRESS} || ' - - [' || strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000] "GET /' || event_type || '?id=' || event_id || ' HTTP/1.0" 200 '
  || CASE WHEN event_id % 9 = 0 THEN '-' ELSE (event_id % 9)::VARCHAR END || ' "-" "-"' AS line FROM events""")
def log_apache(spark, d):
    rows = _log_rows(table(spark, d, "events"))
    uri = F.concat(F.lit("http://host:8000"), F.col("path"), F.lit("?"), F.col("arguments"), F.lit("#top"))
    none = F.lit(None).cast("string")
    line = logs.apache_line(F.col("timestamp"), F.col("ip_address"), F.lit("GET"), uri, F.lit("200"), F.col("event_id") % 9, none, none, none)
    return rows.select("event_id", line.alias("line"))


@query("log_nested", f"""
SELECT floor(epoch(ts))::BIGINT AS timestamp, {_ADDRESS} AS ip_address, coalesce(CASE WHEN event_id % 2 = 0 THEN event_id END, 0) / 1024 AS size, '/' || event_type AS path,
       'a=1&id=' || event_id || '&id=x+y' AS arguments, CASE WHEN event_id % 3 = 0 THEN '404' ELSE '200' END AS status FROM events WHERE event_type <> 'view'""")
def log_nested(spark, d):
    e, n = table(spark, d, "events"), F.col("event_id")
    http = F.struct(
        F.array(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("timestamp"), F.array(F.concat(F.lit("/"), F.col("event_type"))).alias("path"),
        F.array(F.struct(F.concat(F.lit("10.0."), F.floor(F.col("user_id") / 256).cast("string"), F.lit("."), (F.col("user_id") % 256).cast("string")).alias("ip"), F.lit(80).alias("port"))).alias("Client"),
        F.create_map(F.lit("id"), F.array(n.cast("string"), F.lit("x y")), F.lit("a"), F.array(F.lit("1"))).alias("arguments"),
    )
    outer = F.struct(F.array(F.when(n % 2 == 0, n)).alias("size"), F.array(F.lit(0.5)).alias("duration"), F.array(F.lit("200")).alias("httpStatus"))
    inner = F.struct(F.when(n % 3 == 0, F.struct(F.array(F.when(n % 2 == 0, n)).alias("size"), F.array(F.lit(0.5)).alias("duration"), F.array(F.lit("404")).alias("httpStatus"))).alias("httpResponse"))
    nested = e.select(http.alias("httpRequest"), outer.alias("httpResponse"), F.when(F.col("event_type") != "view", inner).alias("sru"))
    have = ["httpRequest", "httpResponse", "sru.httpResponse"]
    request, response = (requests.scoped("", ["sru"], k, have) for k in ("httpRequest", "httpResponse"))
    rows = logs.query_log(nested, "sru", F.col("httpRequest.arguments"), F.lit(None).cast("long"), request, response)
    return rows.select("timestamp", "ip_address", "size", "path", "arguments", "status")


@query("log_collect", "SELECT user_id, event_type, list(event_id ORDER BY ts, event_id) AS values FROM events GROUP BY 1, 2")
def log_collect(spark, d):
    entries = table(spark, d, "events").select("user_id", "event_type", "ts", F.col("event_id").alias("value"))
    return logs.collect_log(entries, ["user_id", "event_type"], ["ts"])


@query("log_retention", "SELECT ts::DATE AS log_date, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 14")
def log_retention(spark, d):
    return logs.daily_counts(table(spark, d, "events"), F.to_date("ts"), 14)


@query("log_kept_rows", "SELECT event_id FROM events WHERE ts::DATE IN (SELECT DISTINCT ts::DATE FROM events ORDER BY 1 DESC LIMIT 14)")
def log_kept_rows(spark, d):
    return logs.newest_days(table(spark, d, "events"), F.to_date("ts"), 14).select("event_id")


@query("response_size", "SELECT user_id, sum(strlen(props))::BIGINT AS size, (floor(epoch(max(ts))) - floor(epoch(min(ts))))::BIGINT AS duration FROM events GROUP BY 1")
def response_size(spark, d):
    chunks = table(spark, d, "events").select("user_id", F.col("props").alias("chunk"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"))
    return logs.collect_chunks(chunks, ["user_id"])


# Scalars.


@query("numeric_convert", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice::VARCHAR::DECIMAL(38,12) * 10)::BIGINT AS tenths, round(l_extendedprice::VARCHAR::DECIMAL(38,12) / 100)::BIGINT AS hundreds FROM lineitem""")
def numeric_convert(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", numeric.scaled("l_extendedprice", 1).alias("tenths"), numeric.scaled("l_extendedprice", -2).alias("hundreds"))


@query("radix_terms", "SELECT p_partkey, 'zzzz' || p_partkey % 10 AS units, 'zzz' || p_partkey // 10 % 10 || 'z' AS tens FROM part")
def radix_terms(spark, d):
    return table(spark, d, "part").select("p_partkey", numeric.radix_term("p_partkey", 0, 5).alias("units"), numeric.radix_term("p_partkey", 1, 5).alias("tens"))


@query("url_parts", r"""
SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host, CASE WHEN url LIKE 'https:%' THEN 443 ELSE 80 END AS port,
       regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '[?]([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages""")
def url_parts(spark, d):
    return table(spark, d, "pages").select("page_id", net.url_parts("url").alias("u")).select("page_id", *[f"u.{c}" for c in ("scheme", "host", "port", "path", "query", "fragment")])


@query("path_filter", r"""
SELECT page_id, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS original_path, '/x' || regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages
WHERE regexp_extract(url, '://[^/?#]*([^?#]*)', 1) SIMILAR TO '/(en|de)/.*' AND regexp_extract(url, '://[^/?#]*([^?#]*)', 1) NOT LIKE '/en/1%'""")
def path_filter(spark, d):
    rows = table(spark, d, "pages").select("page_id", net.url_parts("url")["path"].alias("path"))
    kept = rows.where(requests.path_filter(F.col("path"), ["/en/", "/de/"], ["/en/1"]))
    return requests.path_rename(kept, F.concat(F.lit("/x"), F.col("path"))).select("page_id", "original_path", "path")


@query("ip_ranges", "SELECT event_id FROM events WHERE user_id = 7 OR user_id BETWEEN 16 AND 31 OR user_id BETWEEN 100 AND 120")
def ip_ranges(spark, d):
    rows = _log_rows(table(spark, d, "events"))
    return rows.where(requests.ip_allowed(F.col("ip_address"), ["10.0.0.7"], ["10.0.0.16/28", ("10.0.0.100", "10.0.0.120")])).select("event_id")


@query("range_join", "SELECT DISTINCT event_id FROM events, nation WHERE user_id BETWEEN n_nationkey * 5 AND n_nationkey * 5 + n_regionkey")
def range_join(spark, d):
    ranges = table(spark, d, "nation").select((F.col("n_nationkey") * 5).alias("lo"), (F.col("n_nationkey") * 5 + F.col("n_regionkey")).alias("hi"))
    return requests.in_ranges(table(spark, d, "events"), "user_id", ranges, width=16).select("event_id")


@query("deproxy", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '1.2.3.' || user_id ELSE '127.0.0.1' END AS client FROM events")
def deproxy(spark, d):
    e = table(spark, d, "events").select("event_id", F.lit("127.0.0.1").alias("client"), F.concat(F.lit("9.9.9.9, 1.2.3."), F.col("user_id").cast("string")).alias("xff"), F.lit("a.org, b.org:8080").alias("xfh"))
    return e.select("event_id", net.deproxied("client", "xff", "xfh", F.col("event_id") % 2 == 0)["client"].alias("client"))


@query("version_sort", """
SELECT p_partkey, v, list_transform(string_split(v, '.'), lambda p: CASE WHEN p = 'x' THEN 99887766554433 ELSE p::BIGINT END) < [1, 9] AS early
FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '1.x' ELSE '1.' || p_size || '.' || p_partkey % 10 END AS v FROM part)""")
def version_sort(spark, d):
    v = F.when(F.col("p_partkey") % 7 == 0, "1.x").otherwise(F.concat_ws(".", F.lit("1"), F.col("p_size").cast("string"), (F.col("p_partkey") % 10).cast("string")))
    return table(spark, d, "part").select("p_partkey", v.alias("v"), (numeric.version(v) < numeric.version(F.lit("1.9"))).alias("early"))


_PAST = "(date_part('hour', ts) * 3600 + date_part('minute', ts) * 60 + floor(date_part('second', ts)))"


@query("schedule_next", f"""
SELECT event_id, CASE WHEN 43200 - {_PAST} > 0 THEN 43200 - {_PAST} ELSE 129600 - {_PAST} END::BIGINT AS noon,
  CASE WHEN (9 - isodow(ts)) % 7 * 86400 + 43200 - {_PAST} > 0 THEN (9 - isodow(ts)) % 7 * 86400 + 43200 - {_PAST} ELSE (9 - isodow(ts)) % 7 * 86400 + 648000 - {_PAST} END::BIGINT AS tuesday FROM events""")
def schedule_next(spark, d):
    ts = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", net.seconds_until(ts, "12:00").alias("noon"), net.seconds_until(ts, "12:00", 2).alias("tuesday"))


@query("text_escape", """
SELECT page_id, replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped, md5(html) AS etag,
  CASE WHEN length(html) > 1500 THEN substr(html, 1, 1000) || ' ... ' || right(html, 500) ELSE html END AS short FROM pages""")
def text_escape(spark, d):
    return table(spark, d, "pages").select("page_id", text.xml_escape("url", True).alias("escaped"), text.etag("html").alias("etag"), text.shorten("html").alias("short"))


@query("json_values", "SELECT event_id, 'dict' AS kind, (props->>'k')::BIGINT AS k FROM events")
def json_values(spark, d):
    return table(spark, d, "events").select("event_id", text.json_kind("props").alias("kind"), text.json_or_empty("props", "k long")["k"].alias("k"))


@query("alias_file", "SELECT * FROM (VALUES ('query.title', 'dc:title'), ('query.date', 'dc:date')) AS t(alias, field)")
def alias_file(spark, d):
    lines = ["# aliases", "query.title dc:title", "query.date  dc:date # when", "query.title other", ""]
    return config.aliases(spark.createDataFrame(list(enumerate(lines)), "line int, value string")).select("alias", "field")


@query("session_windows", """
WITH gaps AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
ids AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM gaps)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS requests FROM ids GROUP BY user_id, s""")
def session_windows(spark, d):
    return state.sessions(table(spark, d, "events"), "user_id", "ts", "30 minutes")


@query("xml_validate", "SELECT n_nationkey, n_nationkey <= 9 AS valid FROM nation")
def xml_validate(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey", _nation_xml().alias("xml"))
    return xmlsource.validate(rows, "xml", NATION_XSD).select("n_nationkey", "valid")


@query("xml_parse", "SELECT n_nationkey::BIGINT AS key, n_name AS name FROM nation")
def xml_parse(spark, d):
    return table(spark, d, "nation").select(xmlsource.parsed(_nation_xml(), "key long, name string").alias("x")).select("x.*")


def _nation_xml():
    return F.concat(F.lit("<nation><key>"), F.col("n_nationkey").cast("string"), F.lit("</key><name>"), text.xml_escape("n_name"), F.lit("</name></nation>"))


# Suggestions.

_VOCABULARY = f"(SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TEXT_TOKENS}) AS term FROM documents) GROUP BY 1)"


def _vocabulary(spark, d) -> DataFrame:
    """The vocabulary of a directory's documents, kept as a table in the shared folder; it is counted anew when their files change."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    summary = files.getContentSummary(path)
    name = hashlib.md5(f"{d} {summary.getLength()} {summary.getFileCount()} {files.getFileStatus(path).getModificationTime()}".encode()).hexdigest()
    kept = suggest.Vocabulary(spark, f"{shared_folder(spark)}/vocabulary-{name}")
    return (kept if kept.exists else kept.refresh(table(spark, d, "documents"), "text")).terms


@query("prefix_suggest", f"SELECT term, df FROM {_VOCABULARY} WHERE starts_with(term, 'on') ORDER BY df DESC, term LIMIT 10")
def prefix_suggest(spark, d):
    return suggest.prefix_suggest(_vocabulary(spark, d), "On")


@query("spell_suggest", f"""
SELECT word, term, levenshtein(term, word)::INT AS distance, df FROM {_VOCABULARY}, (VALUES ('thea'), ('worthles')) AS t(word) WHERE levenshtein(term, word) <= 2
QUALIFY row_number() OVER (PARTITION BY word ORDER BY levenshtein(term, word), df DESC, term) <= 5""")
def spell_suggest(spark, d):
    return suggest.corrections(_vocabulary(spark, d), ["thea", "worthles"]).select("word", "term", "distance", "df")


# What is typed and asked, as rows of a log.


@query("webquery_classify", """
SELECT event_id, CASE event_id % 6 WHEN 1 THEN 'plusminus' WHEN 2 THEN 'boolean' WHEN 3 THEN 'boolean' ELSE 'default' END AS kind, event_id % 6 = 4 AS needs_help,
  CASE event_id % 6 WHEN 0 THEN event_type || ' AND u' || user_id WHEN 1 THEN event_type || ' NOT u' || user_id WHEN 2 THEN event_type || ' OR u' || user_id
    WHEN 3 THEN '* NOT ' || event_type WHEN 4 THEN '-' || event_type || ' AND "(u' || user_id || '"' ELSE '*' END AS cql FROM events""")
def webquery_classify(spark, d):
    kind, user = F.col("event_type"), F.concat(F.lit("u"), F.col("user_id").cast("string"))
    forms = [F.concat_ws(" ", kind, user), F.concat(F.lit("+"), kind, F.lit(" -"), user), F.concat(kind, F.lit(" or "), user), F.concat(F.lit("not "), kind), F.concat(F.lit("-"), kind, F.lit(" ("), user), F.lit("")]
    typed = F.element_at(F.array(*forms), (F.col("event_id") % 6 + 1).cast("int"))
    return read_queries(table(spark, d, "events").select("event_id", typed.alias("typed")), "event_id", "typed", "*")


@query("search_requests", """
SELECT event_id, CASE WHEN error IS NULL THEN (page - 1) * 10 END AS start, CASE WHEN error IS NULL THEN least(page * 10, 1000) END AS stop,
  CASE WHEN error IS NULL THEN '-price,status' END AS sort, CASE WHEN error IS NULL THEN 'status:3' END AS facets, error
FROM (SELECT event_id, event_id % 120 AS page, CASE WHEN event_id % 120 = 0 THEN 'Invalid argument: ''page'', expected value > 0'
    WHEN event_id % 120 > 101 THEN 'Invalid argument: ''page'', expected value <= 100' WHEN event_id % 7 = 0 THEN 'Bad argument: ''more'' is an illegal parameter' END AS error FROM events)""")
def search_requests(spark, d):
    page = (F.col("event_id") % 120).cast("string")
    more = F.when(F.col("event_id") % 7 == 0, F.lit("&more=1")).otherwise(F.lit("&x-more=1"))
    asked = F.concat(F.lit("query="), F.col("event_type"), F.lit("&page="), page, F.lit("&sort=-price,+status&facet=status:3"), more)
    return read_requests(table(spark, d, "events").select("event_id", asked.alias("asked")), "event_id", "asked", parse_search, {"start": ("long", lambda r: r.start), "stop": ("long", lambda r: r.stop)} | _TOLD)


#: How sort keys and facets of a request are told.
_TOLD = {
    "sort": ("string", lambda r: ",".join("-" * k.descending + k.field for k in r.sort)),
    "facets": ("string", lambda r: ",".join(f"{f.field}:{f.max_terms}" for f in r.facets)),
}


@query("sru_requests", """
SELECT event_id, CASE WHEN error IS NULL THEN event_id % 50 - 1 END AS start, CASE WHEN error IS NULL THEN event_id % 120 END AS maximum, CASE WHEN error IS NULL THEN '-ts' END AS sort, CASE WHEN error IS NULL THEN 'kind:5,user:10' END AS facets, error
FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '5: 1.' || event_id % 9 WHEN event_id % 50 = 0 THEN '6: startRecord' WHEN event_id % 120 > 100 THEN '6: maximumRecords > 100' END AS error FROM events)""")
def sru_requests(spark, d):
    n = F.col("event_id")
    version = F.when(n % 9 == 0, F.lit("1.0")).otherwise(F.lit("1.2"))
    asked = F.concat(F.lit("operation=searchRetrieve&version="), version, F.lit("&query=kind&sortKeys=ts,,0&x-term-drilldown=kind:5,user&startRecord="), (n % 50).cast("string"), F.lit("&maximumRecords="), (n % 120).cast("string"))
    return read_requests(table(spark, d, "events").select("event_id", asked.alias("asked")), "event_id", "asked", _sru_of_log, {"start": ("long", lambda r: r.start), "maximum": ("long", lambda r: r.maximum)} | _TOLD)


def _sru_of_log(arguments):
    return parse_sru(arguments, maximum_cap=100)


@query("rss_requests", """
SELECT event_id, event_type || ' AND user exact ' || user_id AS cql, event_id % 40 AS size, CASE WHEN event_id % 2 = 1 THEN '-ts' ELSE 'ts' END AS sort, NULL::VARCHAR AS error FROM events""")
def rss_requests(spark, d):
    n = F.col("event_id")
    asked = F.concat(F.lit("query="), F.col("event_type"), F.lit("&filter=user:"), F.col("user_id").cast("string"), F.lit("&maximumRecords="), (n % 40).cast("string"), F.lit("&sortKeys=ts,,"), (n % 2).cast("string"))
    told = {"cql": ("string", lambda r: cql.to_text(r[0])), "size": ("long", lambda r: r[2]), "sort": ("string", lambda r: ",".join("-" * k.descending + k.field for k in r[1]))}
    return read_requests(table(spark, d, "events").select("event_id", asked.alias("asked")), "event_id", "asked", parse_rss, told)


@query("srw_requests", """
SELECT event_id, CASE WHEN event_id % 10 > 0 THEN event_type END AS cql, CASE WHEN event_id % 10 > 0 THEN event_id % 30 END AS maximum, CASE WHEN event_id % 10 = 0 THEN '8: stylesheet' END AS error FROM events""")
def srw_requests(spark, d):
    n = F.col("event_id")
    more = F.when(n % 10 == 0, F.lit("<s:stylesheet>x</s:stylesheet>")).otherwise(F.lit(""))
    body = F.concat(
        F.lit('<e:Envelope xmlns:e="http://schemas.xmlsoap.org/soap/envelope/"><e:Body><s:searchRetrieveRequest xmlns:s="http://www.loc.gov/zing/srw/"><s:query>'),
        F.col("event_type"), F.lit("</s:query><s:maximumRecords>"), (n % 30).cast("string"), F.lit("</s:maximumRecords>"), more, F.lit("</s:searchRetrieveRequest></e:Body></e:Envelope>"),
    )
    rows = table(spark, d, "events").select("event_id", F.concat(F.lit("body="), text.quote_plus(body)).alias("asked"))
    return read_requests(rows, "event_id", "asked", _srw_of_log, {"cql": ("string", lambda r: r.text), "maximum": ("long", lambda r: r.maximum)})


def _srw_of_log(arguments):
    return parse_sru(parse_srw(arguments["body"][0]))


# Requests, cookies and names.


@query("cookie_values", "SELECT event_id, [user_id::VARCHAR, 'x=y'] AS found, []::VARCHAR[] AS none FROM events")
def cookie_values(spark, d):
    header = F.concat(F.lit("a=1; sid="), F.col("user_id").cast("string"), F.lit(";sid=x=y ; sidx=3"))
    return table(spark, d, "events").select("event_id", text.cookie(header, "sid").alias("found"), text.cookie(header, "other").alias("none"))


@query("form_values", "SELECT event_id, ['x y ' || event_id, '&'] AS b, NULL::VARCHAR[] AS c FROM events")
def form_values(spark, d):
    body = F.concat(F.lit("a=1&b=x%20y+"), F.col("event_id").cast("string"), F.lit("&b=%26"))
    return table(spark, d, "events").select("event_id", text.form_argument(body, "b").alias("b"), text.form_argument(body, "c").alias("c"))


@query("basic_auth", """
SELECT event_id, CASE WHEN event_id % 3 > 0 THEN 'u' || user_id END AS login, CASE WHEN event_id % 3 > 0 THEN event_type || ':' || event_id END AS password FROM events""")
def basic_auth(spark, d):
    secret = F.base64(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(":"), F.col("event_type"), F.lit(":"), F.col("event_id").cast("string")).cast("binary"))
    found = text.basic_auth(F.concat(F.when(F.col("event_id") % 3 == 0, F.lit("Bearer ")).otherwise(F.lit("basic ")), secret))
    return table(spark, d, "events").select("event_id", found["user"].alias("login"), found["password"].alias("password"))


@query("filename_variants", """
SELECT p_partkey, list_sort(list_distinct([n, replace(n, '%2E', '.'), replace(replace(n, '%2E', '.'), '+', ' ')])) AS names
FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'plain' ELSE 'part+' || p_partkey || '%2Exml' END AS n FROM part)""")
def filename_variants(spark, d):
    name = F.when(F.col("p_partkey") % 2 == 0, F.lit("plain")).otherwise(F.concat(F.lit("part+"), F.col("p_partkey").cast("string"), F.lit("%2Exml")))
    return table(spark, d, "part").select("p_partkey", F.array_sort(text.filename_variants(name)).alias("names"))


@query("markup_escape", """
SELECT p_partkey, replace(replace(replace(replace(replace(n, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') AS html, n AS back
FROM (SELECT p_partkey, '<a title="' || p_name || '">&' || chr(39) AS n FROM part)""")
def markup_escape(spark, d):
    name = F.concat(F.lit('<a title="'), F.col("p_name"), F.lit("\">&'"))
    return table(spark, d, "part").select("p_partkey", text.html_escape(name).alias("html"), text.xml_unescape(text.xml_escape(name, True)).alias("back"))


@query("dotted_names", """
SELECT event_id, '//a/b' || event_id % 3 AS path, event_type AS leaf, '' AS root_path, '<field name="' || event_type || '">' || event_id || '</field>' AS flat FROM events""")
def dotted_names(spark, d):
    found = text.split_name(F.concat(F.lit("a.b"), (F.col("event_id") % 3).cast("string"), F.lit("."), F.col("event_type")))
    flat = text.flat_field_xml("event_type", F.col("event_id").cast("string"))
    return table(spark, d, "events").select("event_id", found["path"].alias("path"), found["leaf"].alias("leaf"), text.split_name("event_type")["path"].alias("root_path"), flat.alias("flat"))


@query("argument_strings", "SELECT event_id, 'a=1&a=x+y&kind=' || event_type || '&n=' || event_id AS asked, 'a%20b/' || event_id || '%3F' AS quoted FROM events")
def argument_strings(spark, d):
    n = F.col("event_id").cast("string")
    given = F.create_map(F.lit("n"), F.array(n), F.lit("kind"), F.array("event_type"), F.lit("a"), F.array(F.lit("1"), F.lit("x y")))
    return table(spark, d, "events").select("event_id", text.sorted_url_encode(given).alias("asked"), text.quote(F.concat(F.lit("a b/"), n, F.lit("?"))).alias("quoted"))


@query("path_and_query", "SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '^[a-z]+://[^/?#]*', '') AS asked FROM pages")
def path_and_query(spark, d):
    return table(spark, d, "pages").select("page_id", net.path_and_query("url").alias("asked"))


@query("epoch_wait", "SELECT event_id, CASE WHEN 1705363200 - s < 0 THEN 31536000 ELSE 1705363200 - s END AS wait FROM (SELECT event_id, floor(epoch(ts))::BIGINT AS s FROM events)")
def epoch_wait(spark, d):
    return table(spark, d, "events").select("event_id", net.seconds_to_epoch(F.unix_timestamp(F.col("ts").cast("timestamp")), 1705363200).cast("long").alias("wait"))


@query("major_version", "SELECT p_partkey, '1.' || p_size AS own, '1.' || (p_size + 1) AS following, p_size || '.0' AS short FROM part")
def major_version(spark, d):
    v = F.concat(F.lit("1."), F.col("p_size").cast("string"), F.lit(".7"))
    return table(spark, d, "part").select("p_partkey", numeric.major_version(v).alias("own"), numeric.major_version(v, following=True).alias("following"), numeric.major_version(F.col("p_size").cast("string")).alias("short"))


@query("milliseconds", "SELECT event_id, event_id % 800 / 8.0::DOUBLE AS s FROM events")
def milliseconds(spark, d):
    return table(spark, d, "events").select("event_id", numeric.milliseconds(F.col("event_id") % 800 / 8).cast("double").alias("s"))


@query("radix_all", "SELECT p_partkey, ['zz' || p_size % 10, 'z' || p_size // 10 % 10 || 'z', p_size // 100 || 'zz'] AS terms, (p_size // 10 % 10)::VARCHAR AS tens FROM part")
def radix_all(spark, d):
    return table(spark, d, "part").select("p_partkey", numeric.radix_terms("p_size", 3).alias("terms"), numeric.digit("p_size", 1).alias("tens"))


@query("first_of", "SELECT event_id, event_type AS first, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'none' END AS other FROM events")
def first_of(spark, d):
    some = F.when(F.col("event_id") % 2 == 0, F.array("event_type", F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "events").select("event_id", requests.first_of(F.array("event_type", F.lit("x"))).alias("first"), requests.first_of(some, F.lit("none")).alias("other"))


@query("bijection_reverse", "SELECT n_nationkey::VARCHAR AS key, n_name AS value FROM nation")
def bijection_reverse(spark, d):
    return state.reverse(table(spark, d, "nation").select(F.col("n_name").alias("key"), F.col("n_nationkey").cast("string").alias("value")))


# Parts and messages.


@query("part_names", """
SELECT doc_id AS identifier, 'renamed' AS partname, '<quality>' || quality || '</quality>' AS data FROM labels
UNION ALL SELECT doc_id, 'renamed', '<quality>' || quality || '</quality>' FROM labels""")
def part_names(spark, d):
    every = _label_parts(spark, d)
    kept = parts.filter_parts(every, included=["quality"]).unionByName(parts.filter_parts(every, excluded=["toxic"]))
    return parts.rewrite_partname(kept, "renamed").select("identifier", "partname", "data")


@query("message_actions", """
SELECT event_id, CASE WHEN event_type = 'view' THEN 'seen' ELSE event_type END AS action FROM events WHERE event_type IN ('view', 'click')
UNION ALL SELECT event_id, event_type FROM events WHERE event_type <> 'view'""")
def message_actions(spark, d):
    messages = table(spark, d, "events").select("event_id", F.col("event_type").alias("action"))
    some = parts.rewrite_action(parts.filter_actions(messages, allowed=["view", "click"]), "view", "seen")
    return some.unionByName(parts.filter_actions(messages, disallowed=["view"]))


@query("subtrees", "SELECT n_nationkey::VARCHAR AS identifier, '<name>' || n_name || '</name>' AS xml, NULL::VARCHAR AS error FROM nation")
def subtrees(spark, d):
    return fields.select_subtrees(table(spark, d, "nation").select(F.col("n_nationkey").alias("identifier"), _nation_xml().alias("xml")), "name")


@query("subtree_faults", "SELECT n_nationkey::VARCHAR AS identifier, n_nationkey % 2 = 0 AS bad FROM nation")
def subtree_faults(spark, d):
    xml = F.when(F.col("n_nationkey") % 2 == 0, F.lit("<nation><name>")).otherwise(_nation_xml())
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("identifier"), xml.alias("xml"))
    return fields.select_subtrees(rows, "name").select("identifier", F.col("error").isNotNull().alias("bad"))
