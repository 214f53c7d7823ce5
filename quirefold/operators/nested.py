"""Nested records to flat tables, by interval labels.

Every node of a record gets a pre-order number, given when a depth-first walk
enters it, and a post-order number, given when the walk leaves it (both from
one counter). A node lies below another one of the same record exactly if its
interval lies inside the other's. So each node type can be emitted as a table
of its own and be linked to any of its ancestors without keeping paths.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_NODE_FIELDS = "name:string,up:string,ord:int,level:int,pre:bigint,post:bigint,value:string,is_leaf:boolean"
_NODE_TYPE = pa.list_(
    pa.struct(
        [
            ("name", pa.string()),
            ("up", pa.string()),
            ("ord", pa.int32()),
            ("level", pa.int32()),
            ("pre", pa.int64()),
            ("post", pa.int64()),
            ("value", pa.string()),
            ("is_leaf", pa.bool_()),
        ]
    )
)
_NAME = re.compile(r"[\W_]+")


def plain_name(name: str) -> str:
    """A field name without case and separators: ``book_evidence_refs`` and
    ``bookEvidenceRefs`` are one name."""
    return _NAME.sub("", name).lower()


def _decode(text: str):
    """The JSON value of a text, or None if it cannot be read."""
    try:
        return json.loads(text.strip("﻿ \t\r\n"))
    except (ValueError, RecursionError):
        return None


def _opened(value):
    """A string that itself holds a JSON object or array, decoded; else as is."""
    while isinstance(value, str) and value.lstrip("﻿ \t\r\n")[:1] in ("{", "[", '"'):
        inner = _decode(value)
        if not isinstance(inner, (dict, list, str)) or inner == value:
            break
        if isinstance(inner, str) and inner.lstrip("﻿ \t\r\n")[:1] not in ("{", "["):
            break
        value = inner
    return value


def _scalar(value) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value)


def label(payload: str | None, names: frozenset[str] | None = None) -> list[dict]:
    """The labelled nodes of one JSON text, in pre-order.

    The elements of an array stand for the field that holds the array: they
    take its name, and ``ord`` is their position. A bare value where an array
    could stand counts as an array of one, at position 0. JSON texts inside
    strings are opened. ``names`` limits the nodes emitted (never the walk or
    the numbering). An unreadable, blank or null text has no nodes.
    """
    if payload is None or not payload.strip("﻿ \t\r\n"):
        return []
    root = _opened(_decode(payload))
    if not isinstance(root, (dict, list)):
        return []
    out: list[dict] = []
    counter = 0
    # entries: (name, name of the parent, ord, level, value) to enter, or a node to leave
    stack: list = [("", "", i, 0, x) for i, x in reversed(list(enumerate(root)))] if isinstance(root, list) else [("", "", 0, 0, root)]
    while stack:
        entry = stack.pop()
        if isinstance(entry, dict):
            entry["post"] = counter
            counter += 1
            continue
        name, up, at, level, value = entry
        value = _opened(value)
        if isinstance(value, list):  # an array inside an array, or an encoded one
            stack.extend((name, up, i, level, x) for i, x in reversed(list(enumerate(value))))
            continue
        leaf = not isinstance(value, dict)
        node = {"name": name, "up": up, "ord": at, "level": level, "pre": counter, "post": counter, "value": _scalar(value) if leaf else None, "is_leaf": leaf}
        counter += 1
        if names is None or name in names:
            out.append(node)
        stack.append(node)
        if not leaf:
            below: list = []
            for key, x in value.items():
                x = _opened(x)
                key = plain_name(key)
                if isinstance(x, list):
                    below.extend((key, name, i, level + 1, y) for i, y in enumerate(x))
                else:
                    below.append((key, name, 0, level + 1, x))
            stack.extend(reversed(below))
    return out


def label_nodes(df: DataFrame, payload: str, keep: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """One row per node of every JSON text in column ``payload``.

    Result: the columns of ``keep``, then name (normalised by
    :func:`plain_name`; elements carry the name of their array), up (the parent's
    name), ord (position
    in the array as delivered; null elements hold theirs), level, pre, post,
    value (null for objects; numbers that are whole are written plainly),
    is_leaf. Null, blank and unreadable texts give no rows; rows whose keys
    repeat are labelled each for itself. Other columns of ``df`` are dropped,
    so that clashing names do no harm.

    Plan: one narrow Python pass over the texts (Arrow batches); no shuffle.
    """
    wanted = frozenset(plain_name(x) for x in names) if names is not None else None

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = pa.array([label(x, wanted) for x in batch.column(batch.num_columns - 1).to_pylist()], type=_NODE_TYPE)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], nodes], names=[*batch.schema.names[:-1], "__nodes"])

    given = df.select(*[F.col(c) for c in keep], F.col(payload).cast("string").alias("__payload"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    nodes = given.mapInArrow(walk, f"{schema + ', ' if schema else ''}__nodes array<struct<{_NODE_FIELDS}>>")
    return nodes.select(*keep, F.inline("__nodes"))


def with_ancestor(nodes: DataFrame, record: Sequence[str], ancestor: str, into: str) -> DataFrame:
    """Adds struct column ``into`` (ord, pre, post, value): the node named
    ``ancestor`` that encloses each node, or null.

    Nodes of that name are taken not to nest in each other, so the last one
    entered before a node is the only candidate, and it encloses the node if
    it is left after it. Plan: one shuffle on the record key and one sort by
    ``pre``; a record of n nodes costs n log n and no pairs are formed.
    """
    w = Window.partitionBy(*record).orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    fields = F.struct("ord", "pre", "post", "value")
    last = F.last(F.when(F.col("name") == plain_name(ancestor), fields), ignorenulls=True).over(w)
    return nodes.withColumn(into, last).withColumn(into, F.when(F.col(f"{into}.post") > F.col("post"), F.col(into)))


def with_own_field(nodes: DataFrame, record: Sequence[str], element: str, field: str, into: str) -> DataFrame:
    """Adds string column ``into``: for nodes named ``element`` the value of
    their own (not a deeper) field ``field``, else null. Of a repeated field
    the first counts. The plan is that of :func:`with_ancestor`, with the sort
    reversed."""
    w = Window.partitionBy(*record).orderBy(F.desc("pre")).rowsBetween(Window.unboundedPreceding, -1)
    own = (F.col("name") == plain_name(field)) & (F.col("up") == plain_name(element))
    last = F.last(F.when(own, F.struct("post", "value")), ignorenulls=True).over(w)
    inside = (F.col("name") == plain_name(element)) & (F.col(f"{into}.post") < F.col("post"))
    return nodes.withColumn(into, last).withColumn(into, F.when(inside, F.col(f"{into}.value")))


def link_to_parent(nodes: DataFrame, record: Sequence[str], parent: str, children: Sequence[str]) -> DataFrame:
    """The nodes named in ``children`` that lie inside a node named ``parent``,
    with parent_ord, parent_pre and parent_post. Children outside any parent
    give no row. See :func:`with_ancestor`."""
    wanted = [plain_name(c) for c in children]
    linked = with_ancestor(nodes.where(F.col("name").isin(plain_name(parent), *wanted)), record, parent, "__p")
    return (
        linked.where(F.col("name").isin(*wanted) & F.col("__p").isNotNull())
        .withColumns({f"parent_{k}": F.col(f"__p.{k}") for k in ("ord", "pre", "post")})
        .drop("__p")
    )


def node_table(nodes: DataFrame, record: Sequence[str], name: str, parent: str | None = None, fields: Sequence[str] = ()) -> DataFrame:
    """The flat table of one node type: the record key, ord, pre, post, value,
    one string column per own field, and parent_ord, parent_pre, parent_post
    (null for nodes outside ``parent``)."""
    names = {plain_name(name), *map(plain_name, fields), *([plain_name(parent)] if parent else [])}
    out = nodes.where(F.col("name").isin(*names))
    for f in fields:
        out = with_own_field(out, record, name, f, f)
    if parent:
        out = with_ancestor(out, record, parent, "__p")
    out = out.where(F.col("name") == plain_name(name))
    links = [F.col(f"__p.{k}").alias(f"parent_{k}") for k in ("ord", "pre", "post")] if parent else []
    return out.select(*record, "ord", "pre", "post", "value", *fields, *links)
