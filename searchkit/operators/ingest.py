"""Updates: envelopes parsed and checked, no-ops dropped, the last write of a key kept."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPDATE_SCHEMA = "identifier string, action string, partname string, data string, diagnostic string, details string"
#: Diagnostics of rejected updates.
MISSING_BODY, INVALID_DATA, INVALID_COMPONENT = "info:srw/diagnostic/12/9", "info:srw/diagnostic/12/12", "info:srw/diagnostic/12/1"
_ACTIONS = {"create": "add", "replace": "add", "delete": "delete"}


def _child(element: ET.Element | None, name: str) -> ET.Element | None:
    return next((c for c in element if isinstance(c.tag, str) and c.tag.rpartition("}")[2] == name), None) if element is not None else None


def parse_update(body: str | None) -> dict[str, str | None]:
    """One update request: identifier, action (add or delete), part name and data, or a diagnostic."""
    out: dict[str, str | None] = dict.fromkeys(("identifier", "action", "partname", "data", "diagnostic", "details"))
    if not body:
        return out | {"diagnostic": MISSING_BODY, "details": "Update request lacks a record in its body."}
    try:
        root = ET.fromstring(body)
        text = lambda e: e.text if e is not None and e.text else ""
        identifier = text(_child(root, "recordIdentifier"))
        if not identifier.strip():
            raise ValueError("recordIdentifier is mandatory.")
        action = text(_child(root, "action")).partition("info:srw/action/1/")[2]
        if action not in _ACTIONS:
            raise ValueError("action value should refer to either 'create', 'replace' or 'delete'.")
        out |= {"identifier": identifier, "action": _ACTIONS[action]}
        if out["action"] == "add":
            record = _child(root, "record")
            data = _child(record, "recordData")
            if data is None or not len(data):
                raise ValueError("recordData is mandatory.")
            data[0].tail = None
            out |= {"partname": text(_child(record, "recordSchema")), "data": ET.tostring(data[0], encoding="unicode")}
    except (ET.ParseError, ValueError) as e:
        out |= {"diagnostic": INVALID_COMPONENT, "details": str(e)}
    return out


def parse_updates(requests: DataFrame, body_col: str = "body", keep: Sequence[str] = ("seq",)) -> DataFrame:
    """Update requests as rows; rejected ones carry a diagnostic and are never an error of the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse_update(b) for b in batch.column(batch.schema.names.index(body_col)).to_pylist()]
            names = [c.split()[0] for c in UPDATE_SCHEMA.split(", ")]
            added = [pa.array([r[n] for r in rows], pa.string()) for n in names]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.names.index(k)) for k in keep], *added], names=[*keep, *names])

    source = requests.select(*keep, body_col)
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema if f.name in keep)
    return source.mapInArrow(run, f"{kept}, {UPDATE_SCHEMA}")


def latest(updates: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by order: an aggregate, which reduces a hot key before it is shuffled."""
    rest = [c for c in updates.columns if c not in keys and c not in order]
    newest = F.max(F.struct(*order, *rest)).alias("_x")
    return updates.groupBy(*keys).agg(newest).select(*keys, *[f"_x.{c}" for c in [*order, *rest]]).select(*updates.columns)


def apply_updates(stored: DataFrame | None, updates: DataFrame, keys: Sequence[str], order: Sequence[str], deleted: str = "is_deleted", keep_tombstones: bool = False) -> DataFrame:
    """The table after updates: the last write of each key wins; deleted keys go, or stay as tombstones."""
    both = updates if stored is None else stored.unionByName(updates)
    out = latest(both, keys, order)
    return out if keep_tombstones else out.where(~F.col(deleted))


def only_changed(incoming: DataFrame, stored: DataFrame, keys: Sequence[str] = ("identifier", "partname"), data: str = "data") -> DataFrame:
    """Writes that would change something: adds whose data differs, deletes of what isn't deleted already."""
    have = stored.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(data).alias("_data"), F.col("is_deleted").alias("_deleted"))
    same_key = [F.col(k) == F.col(f"_{k}") for k in keys]
    no_op = F.when(F.col("is_deleted"), F.col("_deleted")).otherwise(F.col(data).eqNullSafe(F.col("_data")) & ~F.col("_deleted"))
    return incoming.join(have, [*same_key, no_op], "left_anti")
