"""A CQL tree compiled to one Column over a wide table.

What the index decides is decided here: `=` on a text field, or a bare term, matches
tokens (a term of several tokens matches them in sequence; a trailing `*` matches a
prefix); `==` and `exact` match the whole value; on other fields `=` is equality;
`< <= > >= <>` compare. Null never matches, and NOT is the difference of record sets.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchkit.functions.text import PUNCTUATION, phrase_of
from searchkit.plans.cql import Clause, CqlError, Group, Query


@dataclass(frozen=True)
class Dataset:
    """A wide table and how its fields are searched."""

    frame: DataFrame
    id: str
    text: tuple[str, ...] = ()  # tokenized fields
    default: tuple[str, ...] = ()  # fields that a bare term searches
    aliases: Mapping[str, str] = field(default_factory=dict)  # public name -> column

    def column(self, name: str) -> tuple[Column, str, T.DataType]:
        physical = self.aliases.get(name, name)
        if physical not in self.frame.columns:
            raise CqlError(f"unknown field {name!r}")
        return F.col(physical), physical, self.frame.schema[physical].dataType


_P = "[" + "".join("\\" + c for c in PUNCTUATION) + "]"
#: Between tokens of a phrase: blanks, and words that are no tokens (punctuation with at most one other character).
_GAP = rf"\s++(?:(?:{_P}++|{_P}*+(?!{_P})\S{_P}*+)\s++)*"


def token_pattern(words: list[str], prefix: bool = False) -> str:
    """A pattern that finds tokens in sequence in lower-cased text, without splitting it."""
    body = _GAP.join(f"{_P}*{re.escape(w)}" + ("" if prefix and k == len(words) - 1 else f"{_P}*") for k, w in enumerate(words))
    return rf"(?U)(?<!\S){body}" + ("" if prefix else r"(?!\S)")


def _token_match(value: Column, term: str) -> Column:
    prefix = term.endswith("*") and len(term) > 1
    words = phrase_of(term[:-1] if prefix else term)
    if not words:
        return F.lit(False)
    low = F.lower(value)
    # A plain substring test first: it is cheap, and most rows end there.
    near = functools.reduce(operator.and_, [low.contains(w) for w in words])
    return near & low.rlike(token_pattern(words, prefix))


def _compare(value: Column, kind: T.DataType, relation: str, term: str) -> Column:
    other = F.lit(term) if isinstance(kind, T.StringType) else F.lit(term).try_cast(kind)
    return {"=": value == other, "==": value == other, "exact": value == other, "<>": value != other, "<": value < other, "<=": value <= other, ">": value > other, ">=": value >= other}[relation]


def _clause(c: Clause, data: Dataset) -> Column:
    if c.index is None:
        if c.term == "*":
            return F.lit(True)
        return functools.reduce(operator.or_, [_token_match(data.column(f)[0], c.term) for f in data.default], F.lit(False))
    value, physical, kind = data.column(c.index)
    if isinstance(kind, T.ArrayType):
        if c.relation in ("==", "exact") or physical not in data.text:
            return F.exists(value, lambda v: _compare(v, kind.elementType, c.relation, c.term))
        return F.exists(value, lambda v: _token_match(v, c.term))
    if c.relation == "=" and physical in data.text:
        return _token_match(value, c.term)
    return _compare(value, kind, c.relation, c.term)


def compile_query(tree: Query, data: Dataset) -> Column:
    if isinstance(tree, Clause):
        return _clause(tree, data)
    first, *rest = [compile_query(x, data) for x in tree.operands]
    if tree.operator == "AND":
        return functools.reduce(operator.and_, rest, first)
    if tree.operator == "OR":
        return functools.reduce(operator.or_, rest, first)
    assert isinstance(tree, Group)
    return functools.reduce(lambda a, b: a & ~F.coalesce(b, F.lit(False)), rest, first)
