"""Requests answered whole: arguments in, a response text or object out.

Data stay in Spark; what reaches the driver is a total, at most a page of records and a
few facet terms. Faulty requests get the error form of their API and never an exception.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from decimal import ROUND_HALF_EVEN, Decimal
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchkit.operators import parts, suggest
from searchkit.plans import render
from searchkit.plans.compile import Dataset
from searchkit.plans.cql import CqlError, Query
from searchkit.plans.engine import Response, execute, search, search_sru
from searchkit.plans.requests import Arguments, SoapFault, SruError, parse_rss, parse_search, parse_srw, parse_sru

Facets = dict[str, list[dict[str, Any]]]


def millis(seconds: float) -> Decimal:
    return Decimal(str(seconds)).quantize(Decimal("0.001"), ROUND_HALF_EVEN)


@dataclass
class SearchService:
    """A dataset, the records behind it, and how requests are read.

    records: (identifier, partname, data); labels: (term, label) for facets whose name ends with `.uri`;
    vocabulary: (term, df) for suggestions; rewrite: applied to every query tree.
    """

    data: Dataset
    records: DataFrame
    schema: str
    labels: DataFrame | None = None
    vocabulary: DataFrame | None = None
    rewrite: Callable[[Query], Query] = lambda q: q
    limits: Mapping[str, Any] = field(default_factory=dict)  # keywords of parse_search
    sru_limits: Mapping[str, Any] = field(default_factory=dict)  # keywords of parse_sru
    clock: Callable[[], float] = time.time

    def _hits(self, response: Response, schemas: Sequence[str]) -> list[dict[str, Any]]:
        """The page's identifiers in order, with their parts: one join for all parts."""
        ids = [str(r[self.data.id]) for r in response.hits.select(self.data.id).collect()]
        if not ids:
            return []
        own = self.records.where(F.col("identifier").isin(ids) & F.col("partname").isin(list(schemas))).collect()
        have: dict[str, dict[str, str]] = {}
        for r in own:
            have.setdefault(str(r["identifier"]), {})[r["partname"]] = r["data"]
        return [{"id": i, "data": have.get(i, {})} for i in ids]

    @staticmethod
    def _facets(response: Response) -> Facets | None:
        if response.facets is None:
            return None
        out: Facets = {}
        for r in response.facets.orderBy("fieldname", "rank").collect():
            out.setdefault(r["fieldname"], []).append({"term": r["term"], "count": r["count"]})
        return out

    def _label(self, terms: Sequence[str]) -> Callable[[str], str | None]:
        if self.labels is None or not terms:
            return lambda _: None
        found = {r["term"]: r["label"] for r in self.labels.where(F.col("term").isin(list(terms))).collect()}
        return found.get

    def json(self, arguments: Arguments, path: str = "/search") -> dict[str, Any]:
        """The JSON search."""
        request = None
        try:
            request = parse_search(arguments, record_schema=self.schema, **self.limits)
            began = self.clock()
            response = search(self.data, request, self.rewrite)
            total = response.total.first()["total"]
            items = []
            if request.stop > request.start:
                for hit in self._hits(response, [request.record_schema]):
                    missing = {"identifier": hit["id"], "error": f"The recordSchema '{request.record_schema}' does not exist."}
                    items.append(hit["data"].get(request.record_schema, missing))
            facets = self._facets(response)
            if facets is not None:
                facets = {f.field: facets.get(f.field, []) for f in request.facets}
            uris = [t["term"] for name, terms in (facets or {}).items() if name.endswith(".uri") for t in terms]
            took = millis(self.clock() - began)
            return render.ordered(render.json_response(request, path, total, items, facets, {"handlingTime": took, "queryTime": took}, label=self._label(uris)))
        except ValueError as e:
            return render.ordered(render.json_response(request, path, error=e))

    def _sru(self, arguments: Arguments, host: str, port: int, database: str) -> str:
        request = parse_sru(arguments, record_schema=self.schema, **self.sru_limits)
        if request.operation == "explain":
            return render.explain(request, host, port, database)
        began = self.clock()
        try:
            response = search_sru(self.data, request, self.rewrite)
        except CqlError as e:
            raise SruError(48, str(e)) from None
        total = response.total.first()["total"]
        hits = self._hits(response, [request.record_schema, *request.extra.get("x-recordSchema", [])]) if request.maximum else []
        facets = self._facets(response)
        if facets is not None:
            facets = {f.field: facets.get(f.field, []) for f in request.facets}
        extra = []
        asked = suggest.suggestion_request(request.extra, 5, self.data.default[0] if self.data.default else "")
        if asked and self.vocabulary is not None:
            found: dict[str, list[str]] = {w: [] for w in asked["suggests"]}
            for r in suggest.corrections(self.vocabulary, asked["suggests"], asked["count"]).orderBy("word", "rank").collect():
                found[r["word"]].append(r["term"])
            phrases = suggest.suggested_phrases(" ".join(asked["suggests"]), found)
            if phrases:
                extra.append(render.suggestions(phrases))
        took = millis(self.clock() - began)
        extra.append(render.query_times({"sruHandling": took, "sruQueryTime": took}))
        return render.sru_response(request, total, hits, facets, extra)

    def sru(self, arguments: Arguments, host: str = "localhost", port: int = 80, database: str = "sru") -> str:
        """SRU: searchRetrieve or explain."""
        try:
            return self._sru(arguments, host, port, database)
        except SruError as e:
            return render.sru_error(e)

    def srw(self, body: str) -> str:
        """The same in SOAP."""
        try:
            return render.soap(self._sru(parse_srw(body), "localhost", 80, "sru"))
        except SruError as e:
            return render.soap(render.sru_error(e))
        except SoapFault as e:
            return render.soap_fault(e.code, str(e))

    def rss(self, arguments: Arguments, title: str, description: str, link: str, fields: Mapping[str, tuple[str, str]], link_template: str, **options: Any) -> str:
        """A feed: fields maps title, description and link fields to (part, XPath)."""
        try:
            tree, sort, size = parse_rss(arguments, **options)
            hits = execute(self.data, self.rewrite(tree), 0, size, sort).hits
        except ValueError as e:
            return render.rss(title, description, link, error=e)
        ids = [str(r[self.data.id]) for r in hits.select(self.data.id).collect()]
        rows = parts.fields_of_parts(self.records.where(F.col("identifier").isin(ids)), fields)
        items = parts.rss_items(rows, link_template, [f for f in fields if f"%({f})s" in link_template])
        by_id = {str(r["identifier"]): r["item"] for r in items.select("identifier", "item").collect()}
        return render.rss(title, description, link, [by_id[i] for i in ids if i in by_id])

    def complete(self, prefix: str, limit: int = 10, minimum: int = 2) -> str:
        """Completions of a prefix."""
        if self.vocabulary is None:
            return render.completions(prefix, [])
        return render.completions(prefix, [r["term"] for r in suggest.prefix_suggest(self.vocabulary, prefix, limit, minimum).collect()])
