"""Executing a query: one filter, and three lazy answers over what it matches."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchkit.operators.facets import collapse, term_facets
from searchkit.plans.compile import Dataset, compile_query
from searchkit.plans.cql import Query
from searchkit.plans.requests import Facet, SearchRequest, SortKey, SruRequest


@dataclass
class Response:
    """Lazy frames: matched records, their total (one row), the page of hits, and facets if asked for."""

    matched: DataFrame
    total: DataFrame
    hits: DataFrame
    facets: DataFrame | None = None


def order_by(data: Dataset, sort: Sequence[SortKey]) -> list[Column]:
    """Sort columns, nulls last either way, ties by identifier."""
    keys = [F.col(data.aliases.get(k.field, k.field)) for k in sort]
    return [c.desc_nulls_last() if k.descending else c.asc_nulls_last() for c, k in zip(keys, sort, strict=True)] + [F.col(data.id).asc()]


def page(frame: DataFrame, order: Sequence[Column], start: int, stop: int) -> DataFrame:
    """Rows start to stop of an order: a top-k, never a full sort."""
    return frame.orderBy(*order).offset(start).limit(max(0, stop - start))


def execute(data: Dataset, query: Query, start: int = 0, stop: int = 10, sort: Sequence[SortKey] = (), facets: Sequence[Facet] = (), extra: Sequence[Column] = ()) -> Response:
    """Filter once; count, page and facet what matches."""
    matched = data.frame.where(compile_query(query, data))
    for f in extra:
        matched = matched.where(f)
    counted = term_facets(matched, facets, dict(data.aliases)) if facets else None
    return Response(matched, matched.agg(F.count("*").alias("total")), page(matched, order_by(data, sort), start, stop), counted)


def search(data: Dataset, request: SearchRequest, rewrite: Callable[[Query], Query] = lambda q: q) -> Response:
    return execute(data, rewrite(request.query), request.start, request.stop, request.sort, request.facets)


def search_sru(data: Dataset, request: SruRequest, rewrite: Callable[[Query], Query] = lambda q: q) -> Response:
    return execute(data, rewrite(request.query), request.start, request.start + request.maximum, request.sort, request.facets)


def paging(total: DataFrame, start: int, stop: int, limit_beyond: int | None = None) -> DataFrame:
    """total with has_next, has_previous and next_position (counted from 1; null where there is none)."""
    size, n = stop - start, F.col("total")
    written = F.greatest(F.lit(0), F.least(F.lit(size), n - start))
    following = start + written
    beyond = F.lit(True) if limit_beyond is None else following < limit_beyond
    return total.select(
        "total",
        (F.lit(size > 0) & (n > stop)).alias("has_next"),
        F.lit(size > 0 and start > 0).alias("has_previous"),
        F.when((written > 0) & (following < n) & beyond, following + 1).cast("long").alias("next_position"),
    )


def search_collapsed(data: Dataset, query: Query, key: str, sort: Sequence[SortKey] = (), start: int = 0, stop: int = 10) -> tuple[DataFrame, DataFrame]:
    """Hits with one record a key and their duplicate_count, and totals (total: keys, total_with_duplicates: records)."""
    matched = data.frame.where(compile_query(query, data))
    one = collapse(matched, key, order_by(data, sort)[:-1], data.id)
    totals = one.agg(F.count("*").alias("total"), F.coalesce(F.sum("duplicate_count"), F.lit(0)).alias("total_with_duplicates"))
    return page(one, order_by(data, sort), start, stop), totals
