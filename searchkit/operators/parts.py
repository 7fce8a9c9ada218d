"""Records and their parts: (identifier, partname, data) rows joined, combined and rendered."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchkit.functions.text import quote, xml_escape

#: The namespace of a combined document, unless another is given.
DOCUMENT_NS = "urn:searchkit:document"


def attach_items(hits: DataFrame, records: DataFrame, schema: str, id_col: str = "identifier") -> DataFrame:
    """Hits with data of one part, or the error of a missing one; the hits' own columns tell their order."""
    part = records.where(F.col("partname") == schema).select(F.col("identifier").alias("_id"), F.col("data"))
    error = F.concat(F.lit(f"The recordSchema '{schema}' does not exist."))
    return hits.join(part, F.col(id_col) == F.col("_id"), "left").withColumn("error", F.when(F.col("data").isNull(), error)).drop("_id")


def attach_schemas(hits: DataFrame, records: DataFrame, schemas: Sequence[str], id_col: str = "identifier") -> DataFrame:
    """Hits with a column for each of several parts: one join and one aggregate for all of them."""
    own = records.where(F.col("partname").isin(list(schemas))).groupBy(F.col("identifier").alias("_id")).agg(*[F.max(F.when(F.col("partname") == s, F.col("data"))).alias(s) for s in schemas])
    return hits.join(own, F.col(id_col) == F.col("_id"), "left").drop("_id")


def filter_parts(records: DataFrame, included: Sequence[str] | None = None, excluded: Sequence[str] | None = None) -> DataFrame:
    if (included is None) == (excluded is None):
        raise ValueError("give either included or excluded part names")
    return records.where(F.col("partname").isin(list(included))) if included is not None else records.where(~F.col("partname").isin(list(excluded)))


def filter_actions(messages: DataFrame, allowed: Sequence[str] | None = None, disallowed: Sequence[str] | None = None) -> DataFrame:
    if (allowed is None) == (disallowed is None):
        raise ValueError("give either allowed or disallowed actions")
    return messages.where(F.col("action").isin(list(allowed))) if allowed is not None else messages.where(~F.col("action").isin(list(disallowed)))


def rewrite_action(messages: DataFrame, old: str, new: str) -> DataFrame:
    return messages.withColumn("action", F.when(F.col("action") == old, F.lit(new)).otherwise(F.col("action")))


def rewrite_partname(records: DataFrame, partname: str) -> DataFrame:
    return records.withColumn("partname", F.lit(partname))


def combine_parts(records: DataFrame, parts: Sequence[str], optional: Sequence[str] = (), namespace: str = DOCUMENT_NS) -> DataFrame:
    """(identifier, data): the parts of each record, in the order declared, in one document envelope.

    Records that lack a part that isn't optional have no row. A record has a row for each declared part, so a list of
    them is as long as the declaration, unless the input repeats parts.
    """
    place = F.create_map(*[x for i, p in enumerate(parts) for x in (F.lit(p), F.lit(i))])
    piece = F.concat(F.lit('<doc:part name="'), xml_escape("partname"), F.lit('">'), F.col("data"), F.lit("</doc:part>"))
    grouped = records.where(F.col("partname").isin(list(parts))).groupBy("identifier").agg(F.sort_array(F.collect_list(F.struct(place[F.col("partname")].alias("pos"), piece.alias("xml")))).alias("x"), F.collect_set("partname").alias("have"))
    required = F.array(*[F.lit(p) for p in parts if p not in optional]).cast("array<string>")
    body = F.array_join("x.xml", "")
    return grouped.where(F.size(F.array_except(required, "have")) == 0).select("identifier", F.concat(F.lit(f'<doc:document xmlns:doc="{namespace}">'), body, F.lit("</doc:document>")).alias("data"))


def resolve_parts(envelopes: DataFrame, stored: DataFrame, should: Mapping[str, str], could: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Parts of incoming records: from the envelope (an XPath to text or attribute) or else from what is stored.

    Returns (identifier, partname, data) and (identifier, error) of records that lack a `should` part,
    have an empty identifier, or for which an XPath has several results.
    """
    wanted = {**should, **could}
    found = F.array(*[F.struct(F.lit(p).alias("partname"), F.xpath("xml", F.lit(x)).alias("found")) for p, x in wanted.items()])
    rows = envelopes.select("identifier", F.explode(found).alias("p")).select("identifier", "p.partname", "p.found")
    kept = stored.where(F.col("partname").isin(list(wanted))).select(F.col("identifier").alias("_id"), F.col("partname").alias("_part"), F.col("data").alias("_data"))
    rows = rows.join(kept, (F.col("identifier") == F.col("_id")) & (F.col("partname") == F.col("_part")), "left")
    rows = rows.withColumn("data", F.coalesce(F.get("found", F.lit(0)), "_data"))
    required = F.col("partname").isin(list(should))
    error = (
        F.when(F.coalesce(F.col("identifier"), F.lit("")) == "", "Empty identifier not allowed.")
        .when(F.size("found") > 1, F.concat(F.lit("XPath of '"), F.col("partname"), F.lit("' should return at most one result.")))
        .when(required & F.col("data").isNull(), F.concat(F.lit("Expected '"), F.col("partname"), F.lit("'")))
    )
    rows = rows.withColumn("error", error)
    by_record = rows.groupBy("identifier").agg(F.min("error").alias("error"), F.collect_list(F.when(F.col("data").isNotNull(), F.struct("partname", "data"))).alias("parts"))
    good = by_record.where("error is null").select("identifier", F.explode("parts").alias("p")).select("identifier", "p.partname", "p.data")
    return good, by_record.where("error is not null").select("identifier", "error")


def fields_of_parts(records: DataFrame, fields: Mapping[str, tuple[str, str]]) -> DataFrame:
    """(identifier, one column for each field): the first result of each (part, XPath); every part is read once."""
    parts = sorted({p for p, _ in fields.values()})
    wide = records.where(F.col("partname").isin(parts)).groupBy("identifier").agg(*[F.max(F.when(F.col("partname") == p, F.col("data"))).alias(f"_{i}") for i, p in enumerate(parts)])
    return wide.select("identifier", *[F.get(F.xpath(F.col(f"_{parts.index(p)}"), F.lit(x)), F.lit(0)).alias(n) for n, (p, x) in fields.items()])


def fill(template: str, values: Mapping[str, Column]) -> Column:
    """A `%(name)s` template with values put in."""
    out: list[Column] = []
    rest = template
    while "%(" in rest:
        before, _, rest = rest.partition("%(")
        name, _, rest = rest.partition(")s")
        out += [F.lit(before), values[name]]
    return F.concat(*out, F.lit(rest))


def compose(rows: DataFrame, template: str, fields: Sequence[str]) -> DataFrame:
    """rows with `record`: the template with escaped values, or '' when any is missing."""
    whole = F.lit(True)
    for f in fields:
        whole = whole & F.col(f).isNotNull()
    return rows.withColumn("record", F.when(whole, fill(template, {f: xml_escape(F.col(f).cast("string")) for f in fields})).otherwise(""))


#: Fixed value: an RSS item.
RSS_ITEM = "<item>\n    <title>%(title)s</title>\n    <description>%(description)s</description>\n    <link>%(link)s</link>\n    <guid>%(link)s</guid>\n</item>"


def rss_items(rows: DataFrame, link_template: str, link_fields: Sequence[str], title: str = "title", description: str = "description") -> DataFrame:
    """rows with `item`: missing title and description are empty, and the link too when a link field is missing."""
    link = fill(link_template, {f: quote(F.col(f).cast("string")) for f in link_fields})
    value = lambda c: xml_escape(F.coalesce(F.col(c).cast("string"), F.lit("")))
    values = {"title": value(title), "description": value(description), "link": xml_escape(F.coalesce(link, F.lit("")))}
    return rows.withColumn("item", fill(RSS_ITEM, values))
