"""Text functions as columns: tokens, escaping, dotted names, small web formats."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = string.punctuation


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


_P = "[" + "".join("\\" + c for c in PUNCTUATION) + "]"
#: A word from its first to its last character that isn't punctuation, if it has two of these or more.
_TOKEN = rf"(?U)(?<!\S){_P}*+(\S(?:\S*(?!{_P})\S))"


def tokens(value: str | Column) -> Column:
    """Lower-cased tokens: split on Unicode whitespace, ASCII punctuation off both ends, longer than one character.

    One pattern, which compiles into the stage, finds them all.
    """
    return F.regexp_extract_all(F.lower(col(value)), F.lit(_TOKEN), F.lit(1))


def phrase_of(text: str) -> list[str]:
    """The tokens of a query term (the same rules, on the driver)."""
    return [t for t in (w.strip(PUNCTUATION).lower() for w in text.split()) if len(t) > 1]


def xml_escape(value: str | Column, attribute: bool = False) -> Column:
    out = col(value)
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")) + ((('"', "&quot;"),) if attribute else ()):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def xml_unescape(value: str | Column) -> Column:
    out = col(value)
    for char, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"), ("&", "&amp;")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def html_escape(value: str | Column) -> Column:
    return F.replace(xml_escape(value, attribute=True), F.lit("'"), F.lit("&#x27;"))


def dotted_to_xml(name: str | Column, value: str | Column) -> Column:
    """`a.b` and v to `<a><b>v</b></a>`; null when a segment isn't a word."""
    segments = F.split(col(name), r"\.")
    nested = F.aggregate(F.reverse(segments), xml_escape(value), lambda acc, s: F.concat(F.lit("<"), s, F.lit(">"), acc, F.lit("</"), s, F.lit(">")))
    return F.when(F.forall(segments, lambda s: s.rlike(r"(?U)^\w+$")), nested)


def flat_field_xml(name: str | Column, value: str | Column) -> Column:
    return F.concat(F.lit('<field name="'), xml_escape(name, attribute=True), F.lit('">'), xml_escape(value), F.lit("</field>"))


def split_name(name: str | Column) -> Column:
    """A dotted name as the path of its parents and its leaf."""
    n = col(name)
    leaf = F.substring_index(n, ".", -1)
    parents = F.when(F.instr(n, ".") > 0, F.concat(F.lit("//"), F.replace(F.substring(n, F.lit(1), F.length(n) - F.length(leaf) - 1), F.lit("."), F.lit("/")))).otherwise("")
    return F.struct(parents.alias("path"), leaf.alias("leaf"))


def shorten(value: str | Column, longest: int = 1500, head: int = 1000, tail: int = 500) -> Column:
    v = col(value)
    return F.when(F.length(v) > longest, F.concat(F.substring(v, 1, head), F.lit(" ... "), F.right(v, F.lit(tail)))).otherwise(v)


def quote_plus(value: str | Column) -> Column:
    """Percent-encoding with `+` for a blank, leaving letters, digits and `_.-~`."""
    return F.replace(F.replace(F.url_encode(col(value)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def quote(value: str | Column) -> Column:
    """Percent-encoding for paths: `%20` for a blank, and `/` left."""
    return F.replace(F.replace(quote_plus(value), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def sorted_url_encode(arguments: str | Column) -> Column:
    """A map of lists as a query string: keys sorted, each value in order."""
    entries = F.array_sort(F.map_keys(col(arguments)))
    pairs = F.flatten(F.transform(entries, lambda k: F.transform(F.element_at(col(arguments), k), lambda v: F.concat(quote_plus(k), F.lit("="), quote_plus(v)))))
    return F.array_join(pairs, "&")


def form_argument(body: str | Column, name: str) -> Column:
    """Values of one name in a form body: null if absent."""
    pairs = F.filter(F.split(col(body), "&"), lambda p: F.substring_index(p, "=", 1) == F.lit(name))
    values = F.transform(pairs, lambda p: F.url_decode(F.regexp_replace(p, "^[^=]*=?", "")))
    return F.when(F.size(values) > 0, values)


def cookie(header: str | Column, name: str) -> Column:
    """Values of the cookies of one name."""
    pairs = F.transform(F.split(col(header), ";"), lambda p: F.trim(p))
    own = F.filter(pairs, lambda p: F.substring_index(p, "=", 1) == F.lit(name))
    return F.transform(own, lambda p: F.regexp_replace(p, "^[^=]*=?", ""))


def basic_auth(header: str | Column) -> Column:
    """User and password of a Basic authorization header; null for anything else."""
    h = col(header)
    decoded = F.try_to_binary(F.trim(F.regexp_extract(h, "(?i)^Basic\\s+(.*)$", 1)), F.lit("base64")).cast("string")
    return F.when(h.rlike("(?i)^Basic\\s") & decoded.contains(":"), F.struct(F.substring_index(decoded, ":", 1).alias("user"), F.regexp_replace(decoded, "^[^:]*:", "").alias("password")))


def filename_variants(name: str | Column) -> Column:
    """A file name as it is, percent-decoded, and decoded with `+` as a blank; each once."""
    n = col(name)
    plain = F.try_url_decode(F.replace(n, F.lit("+"), F.lit("%2B")))
    return F.array_compact(F.array_distinct(F.array(n, plain, F.try_url_decode(n))))


def etag(content: str | Column) -> Column:
    return F.md5(col(content).cast("binary"))


def json_kind(value: str | Column) -> Column:
    """`dict` or `list` by the first character, which may not be blank; null for anything else."""
    first = F.substring(col(value), 1, 1)
    return F.when(first == "{", "dict").when(first == "[", "list")


def json_or_empty(value: str | Column, schema: str) -> Column:
    """Parsed JSON; what doesn't parse is an empty object."""
    return F.coalesce(F.from_json(col(value), schema), F.from_json(F.lit("{}"), schema))
