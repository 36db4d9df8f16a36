"""Deeply nested semi-structured records to related flat tables.

A merged schema is inferred over all records, at any depth, then each array level becomes a child
table that carries the surrogate key of its parent and the element's ordinal.  An object whose member
names are data becomes a child table too, with a row for each member and its name.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOOKS_LIKE_JSON = r"^\s*[\[{]"
#: The table of the elements of records that are arrays, and the column with the name of a map's member.
LIST, MEMBER = "[]", "member_name"


#: An object with more member names than this over all records is a map whose names are data.
MOST_MEMBERS = 1000


@dataclass
class Node:
    """A path of the merged schema: the shapes its values take, its members, its elements.

    A map has no members; its values are elements.
    """

    shapes: set[str] = field(default_factory=set)
    members: dict[str, Node] = field(default_factory=dict)
    element: Node | None = None

    @property
    def is_map(self) -> bool:
        return "map" in self.shapes

    def member(self, name: str, most: int) -> Node:
        """The node of a member; beyond `most` names the object turns into a map."""
        if self.is_map:
            return self.item()
        found = self.members.get(name)
        if found is None:
            if len(self.members) >= most:
                self.to_map(most)
                return self.item()
            found = self.members[name] = Node()
        return found

    def item(self) -> Node:
        if self.element is None:
            self.element = Node()
        return self.element

    def to_map(self, most: int) -> None:
        self.shapes.add("map")
        inner, self.members = self.members, {}
        for child in inner.values():
            self.item().join(child, most)

    def join(self, other: Node, most: int) -> None:
        """Take in what another node of the same path has met."""
        open_ = [(self, other)]
        while open_:
            mine, theirs = open_.pop()
            if theirs.is_map and not mine.is_map:
                mine.to_map(most)
            mine.shapes |= theirs.shapes
            open_ += [(mine.member(name, most), child) for name, child in theirs.members.items()]
            if theirs.element is not None:
                open_.append((mine.item(), theirs.element))

    def add(self, value: object, most: int) -> None:
        """Take in one value."""
        open_ = [(self, value)]
        while open_:
            node, value = open_.pop()
            kind = kind_of(value)
            if kind == "string" and _embedded(value):
                ok, inner = read_json(value)
                if ok:
                    node.shapes.add("embedded")
                    value, kind = inner, kind_of(inner)
            node.shapes.add(kind)
            if kind == "object":
                open_ += [(node.member(k, most), v) for k, v in value.items()]
            elif kind == "array":
                item = node.item() if value else None
                open_ += [(item, v) for v in value]

    def lines(self) -> list[list]:
        """The node and all below it as [place of the parent, name or null for an element, shapes], parents first."""
        found: list[list] = []
        open_: list[tuple[int, str | None, Node]] = [(-1, None, self)]
        while open_:
            parent, name, node = open_.pop()
            found.append([parent, name, sorted(node.shapes)])
            at = len(found) - 1
            open_ += [(at, k, child) for k, child in node.members.items()]
            if node.element is not None:
                open_.append((at, None, node.element))
        return found

    @staticmethod
    def read(lines: list[list]) -> Node:
        nodes: list[Node] = []
        for parent, name, shapes in lines:
            node = Node(set(shapes))
            if parent >= 0 and name is None:
                nodes[parent].element = node
            elif parent >= 0:
                nodes[parent].members[name] = node
            nodes.append(node)
        return nodes[0]


def _reject(constant: str) -> None:
    raise ValueError(f"{constant} is no JSON")


def read_json(text: str | None) -> tuple[bool, object]:
    """(whether the text is one valid JSON value, the value)."""
    if text is None:
        return False, None
    try:
        return True, json.loads(text, parse_constant=_reject)
    except (ValueError, RecursionError):
        return False, None


_KINDS = {dict: "object", list: "array", str: "string", type(None): "null", bool: "boolean"}


def kind_of(value: object) -> str:
    return _KINDS.get(type(value), "number")


def _embedded(text: str) -> bool:
    """Whether a text looks like JSON of an object or array."""
    return text[:1] in "[{" and text != "" or text[:1].isspace() and text.lstrip()[:1] in ("[", "{")


def infer(payloads: DataFrame, column: str, *, most_members: int = MOST_MEMBERS) -> Node:
    """The merged schema of all JSON texts of `column`, in one pass over the payloads.

    Each partition hands on one merged schema, one task merges these, and the driver receives one.
    An object with more than `most_members` member names is a map with data as names, in a partition
    or when they are merged; from then on its values share one node.  So a node never has more members
    than that, wherever it is held, whatever the data.
    """

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = Node()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                ok, value = read_json(text)
                if ok:
                    root.add(value, most_members)
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(root.lines())])], ["schema"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = Node()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                root.join(Node.read(json.loads(text)), most_members)
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(root.lines())])], ["schema"])

    parts = payloads.select(column).mapInArrow(seen, "schema string")
    root = Node()
    for row in parts.repartition(1).mapInArrow(merged, "schema string").collect():
        root.join(Node.read(json.loads(row.schema)), most_members)
    return _settled(root, most_members)


def _settled(root: Node, most_members: int) -> Node:
    """Where arrays and objects meet below the root, an object is an array of one, so its members join the elements'."""
    open_ = [root]
    while open_:
        node = open_.pop()
        if node is not root and node.element is not None and node.members:
            node.element.join(Node({"object"}, node.members), most_members)
            node.members = {}
        open_ += node.members.values()
        if node.element is not None:
            open_.append(node.element)
    return root


def _is_container(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull() | F.try_variant_get(value, "$", "array<variant>").isNotNull()


def unwrap(value: Column) -> Column:
    """A variant, or what its text holds where that is itself JSON of an object or array."""
    text = F.when(~_is_container(value), as_text(value))
    return F.coalesce(F.try_parse_json(F.when(text.rlike(_LOOKS_LIKE_JSON), text)), value)


def as_text(value: Column) -> Column:
    """A scalar variant as text; null for null."""
    return F.try_variant_get(value, "$", "string")


def elements(value: Column, node: Node, separator: str | None = ",") -> Column:
    """A variant as array of variants, whatever shape it was delivered in.

    An array stays; a text is split at `separator` and trimmed; a map gives its values; an object or
    another scalar is an array of one; null and a missing member are null.  Shapes that `node` hasn't
    met cost nothing.
    """
    array = F.try_variant_get(value, "$", "array<variant>")
    if node.is_map:
        array = F.coalesce(array, F.map_values(F.try_variant_get(value, "$", "map<string,variant>")))
    others = node.shapes - {"array", "null", "embedded", "map"} - ({"object"} if node.is_map else set())
    if not others:
        return array
    other = F.array(value)
    if separator and "string" in others:
        words = F.transform(F.split(as_text(value), re.escape(separator)), lambda x: F.to_json(F.array(F.trim(x))))
        words = F.transform(words, lambda x: F.try_variant_get(F.try_parse_json(x), "$[0]", "variant"))
        other = F.when(F.schema_of_variant(value) == "STRING", words).otherwise(other)
    return F.coalesce(array, F.when(~F.is_variant_null(value), other))


def _step(name: str) -> str:
    """A path step to a member, in the quotes its name allows."""
    return f'["{name}"]' if "'" in name else f"['{name}']"


@dataclass
class Tables:
    """The flat tables of one payload column; a table is planned when it is asked for."""

    schema: Node
    root: DataFrame
    separator: str | None = ","

    def _walk(self, node: Node, root: bool = False) -> Iterator[tuple[str, Node, str, str]]:
        """(dotted name, node, embedding, path) of each scalar, array and map below a row.

        A path leads from the row's variant, or from a member that holds JSON as text; such a member
        is the embedding ``base:path`` that has to be read first.
        """
        open_ = [("", node, "_v", "$")]
        while open_:
            name, node, base, path = open_.pop()
            if "embedded" in node.shapes and path != "$":
                base, path = f"{base}:{path}", "$"
            if root and not name and node.element is not None:
                yield LIST, node, base, path
            elif node.element is not None or not node.members:
                yield name, node, base, path
                continue
            children = sorted(node.members.items(), reverse=True)
            open_ += [(f"{name}.{m}" if name else m, child, base, path + _step(m)) for m, child in children]

    def paths(self) -> list[str]:
        """The paths of all array and map tables, parents first."""
        found: list[str] = []
        open_ = deque([("", self.schema)])
        while open_:
            prefix, node = open_.popleft()
            for name, child, _, _ in self._walk(node, not prefix):
                if child.element is not None and name:
                    found.append(f"{prefix}.{name}" if prefix else name)
                    open_.append((found[-1], child.element))
        return found

    def _staged(self, rows: DataFrame, wanted: list[tuple[str, Node, str, str]]) -> tuple[DataFrame, list[Column]]:
        """`rows` with a column for each embedding that `wanted` needs, and the variants of `wanted`."""
        named = {"_v": "_v"}
        for _, _, base, _ in wanted:
            steps = base.split(":")
            for i in range(1, len(steps)):
                key = ":".join(steps[: i + 1])
                if key not in named:
                    named[key] = f"_v{len(named)}"
                    inner = F.try_variant_get(F.col(named[":".join(steps[:i])]), steps[i], "variant")
                    rows = rows.withColumn("_raw", inner).withColumn(named[key], unwrap(F.col("_raw"))).drop("_raw")
        return rows, [F.try_variant_get(F.col(named[base]), path, "variant") if path != "$" else F.col(named[base]) for _, _, base, path in wanted]

    def _rows(self, path: str) -> tuple[DataFrame, Node]:
        """The rows of a table with their variant `_v`, and their node."""
        if not path:
            return self.root, self.schema
        best = max((p for p in ["", *self.paths()] if p != path and (not p or path.startswith(f"{p}."))), key=len)
        above, node = self._rows(best)
        name = path[len(best) + 1 :] if best else path
        wanted = [w for w in self._walk(node, not best) if w[0] == name and w[1].element is not None]
        if not wanted:
            raise KeyError(path)
        staged, (value,) = self._staged(above, wanted)
        child = wanted[0][1]
        staged = staged.select(F.col("row_key").alias("parent_key"), value.alias("_raw"))
        # A record that is no array isn't one in its own place either: its members are in the root's row.
        shape = Node({"array"} | (child.shapes & {"map"})) if name == LIST else child
        values = elements(F.col("_raw"), shape, self.separator)
        if child.is_map:
            names = F.map_keys(F.try_variant_get("_raw", "$", "map<string,variant>"))
            values = F.arrays_zip(values.alias("e"), F.coalesce(names, F.array().cast("array<string>")).alias("m"))
        else:
            values = F.transform(values, lambda e: F.struct(e.alias("e")))
        staged = staged.select("parent_key", values.alias("_all"))
        # The outer form keeps the optimizer from testing the array's size in a filter that reads the text again.
        inner = staged.select("parent_key", F.posexplode_outer("_all").alias("ordinal", "_x")).where(F.col("_x.e").isNotNull() & ~F.is_variant_null("_x.e"))
        element = unwrap(F.col("_x.e")) if "embedded" in child.element.shapes else F.col("_x.e")
        key = F.concat("parent_key", F.lit(f"/{name}["), F.col("ordinal").cast("string"), F.lit("]"))
        named = [F.col("_x.m").alias(MEMBER)] if child.is_map else []
        return inner.select(key.alias("row_key"), "parent_key", "ordinal", *named, element.alias("_v")), child.element

    def table(self, path: str = "") -> DataFrame:
        """(row_key, parent_key, ordinal, the row's scalar members as text by dotted name); a map's table has the member's name as `MEMBER`."""
        rows, node = self._rows(path)
        wanted = [w for w in self._walk(node, not path) if w[1].element is None]
        staged, values = self._staged(rows, wanted)
        named = [as_text(v).alias(w[0] or "value") for w, v in zip(wanted, values)]
        return staged.select("row_key", *(["parent_key", "ordinal"] if path else []), *(c for c in (MEMBER,) if c in rows.columns), *named)

    def leaves(self, wanted: dict[str, tuple[str, str]]) -> DataFrame:
        """(parent_key, leaf, ordinal, text) of chosen scalar members of several child tables of the root.

        `wanted` names each leaf by (path of the table, dotted name of the member).  All of them come
        from one reading of the payload: an array with an entry for each leaf of each element, exploded
        once.  A path or member that the schema hasn't met gives no rows.
        """
        by_path: dict[str, dict[str, str]] = {}
        for leaf, (path, name) in wanted.items():
            by_path.setdefault(path, {})[leaf] = name
        apart = [p for p in by_path if any(p.startswith(f"{q}.") for q in self.paths())]
        found = [self.table(p).select("parent_key", F.lit(leaf).alias("leaf"), "ordinal", F.col(f"`{n}`").alias("text")) for p in apart for leaf, n in by_path[p].items() if p in self.paths() and n in self.table(p).columns]
        arrays = [w for w in self._walk(self.schema, True) if w[0] in by_path and w[0] not in apart and w[1].element is not None]
        if arrays:
            staged, values = self._staged(self.root, arrays)
            parts = []
            for (path, node, _, _), value in zip(arrays, values):
                inner = list(self._walk(node.element))
                chosen = [(leaf, *next(((b, p) for n, c, b, p in inner if (n or "value") == name and c.element is None), (None, None))) for leaf, name in by_path[path].items()]
                chosen = [c for c in chosen if c[1] is not None]
                if any(b.count(":") for _, b, _ in chosen):  # JSON as text below an element needs a stage of its own
                    found += [self.table(path).select("parent_key", F.lit(leaf).alias("leaf"), "ordinal", F.col(f"`{by_path[path][leaf]}`").alias("text")) for leaf, _, _ in chosen]
                    continue
                parts += [F.transform(elements(value, node, self.separator), self._entry(node.element, leaf, p)) for leaf, _, p in chosen]
            if parts:
                every = F.flatten(F.array(*(F.coalesce(p, F.array().cast("array<struct<leaf:string,ordinal:int,text:string>>")) for p in parts)))
                staged = staged.select(F.col("row_key").alias("parent_key"), F.explode_outer(every).alias("_l"))
                found.append(staged.select("parent_key", "_l.leaf", "_l.ordinal", "_l.text"))
        if not found:
            return self.root.sparkSession.createDataFrame([], "parent_key string, leaf string, ordinal int, text string")
        rows = found[0]
        for more in found[1:]:
            rows = rows.unionAll(more)
        return rows.where("text is not null")

    @staticmethod
    def _entry(node: Node, leaf: str, path: str):  # noqa: ANN205
        def entry(element: Column, ordinal: Column) -> Column:
            value = unwrap(element) if "embedded" in node.shapes else element
            return F.struct(F.lit(leaf).alias("leaf"), ordinal.cast("int").alias("ordinal"), F.try_variant_get(value, path, "string").alias("text"))

        return entry

    def all(self) -> dict[str, DataFrame]:
        return {p: self.table(p) for p in ["", *self.paths()]}


def flatten(df: DataFrame, key: str, payload: str, *, separator: str | None = ",", schema: Node | None = None, distinct: bool = True) -> Tables:
    """Related flat tables of the JSON texts in `payload`.

    The root table has a row for each distinct (key, payload) with valid JSON, with `row_key`, the
    key as text, and the scalar members by dotted path.  Every array, at any level, has a table of
    its own named by its path, with `row_key` (``parent_key/path[ordinal]``), `parent_key`, `ordinal`
    from 0 and its elements' scalar members; an element that is no object is `value`.

    Cases:
    - payloads that are null, blank or no valid JSON, and rows with a null key, give no rows;
    - JSON held as text in a member is read as if it stood there itself;
    - a member that is an array in some records is one in all: an object or a number is an array of
      one, a text is split at `separator` (None: not split), null and missing have no rows;
    - a null element has no row but takes an ordinal, and so does a repeated element;
    - a record that is itself an array has a root row, and its elements are the table ``[]``;
    - scalars are text, so members of different kinds meet; missing and null members are null;
    - repeated rows count once; an empty table gives an empty root and no child.

    `schema` saves the inference where it is known from an earlier run; ``distinct=False`` saves the
    shuffle of the payloads where repeated rows do no harm or don't occur.
    """
    schema = schema or infer(df, payload)
    rows = df.select(F.col(key).cast("string").alias("row_key"), F.col(payload).alias("_t")).where("row_key is not null and _t is not null")
    rows = rows.distinct() if distinct else rows
    # In brackets, text behind the first value makes the whole invalid or a longer array.  The generator
    # between parsing and the tests keeps the text from being parsed again for each of them.
    rows = rows.select("row_key", F.explode_outer(F.array(F.try_parse_json(F.concat(F.lit("["), "_t", F.lit("]"))))).alias("_w"))
    one = F.try_variant_get("_w", "$[0]", "variant").isNotNull() & F.try_variant_get("_w", "$[1]", "variant").isNull()
    value = F.try_variant_get("_w", "$[0]", "variant")
    return Tables(schema, rows.where(one).select("row_key", (unwrap(value) if "embedded" in schema.shapes else value).alias("_v")), separator)


def whole_number(text: Column) -> Column:
    """A number without decimals as text, from ``131072``, ``131072.0``, ``1.31072e5`` or ``131,072``; null for others."""
    plain = F.trim(text)
    plain = F.when(plain.rlike(r"^\d{1,3}(,\d{3})+$"), F.replace(plain, F.lit(","), F.lit(""))).otherwise(plain)
    n = F.when(plain.rlike(r"^[+-]?\d+(\.\d*)?([eE][+-]?\d+)?$"), plain).try_cast("decimal(38,6)")
    return F.when(n == F.floor(n), F.floor(n).cast("decimal(38,0)").cast("string"))


def endpoint_members(payloads: DataFrame, *, schema: Node | None = None) -> DataFrame:
    """Distinct (payload_id, field_name, item_pos, found_value) of endpoint envelopes.

    Provider names are trimmed and left out where blank; context lengths are whole numbers; each
    place of the input modalities counts.  A missing path gives no rows.
    """
    tables = flatten(payloads, "payload_id", "payload", schema=schema, distinct=False)
    found = tables.leaves({
        "provider_name": ("data.endpoints", "provider_name"),
        "context_length": ("data.endpoints", "context_length"),
        "input_modality": ("data.architecture.input_modalities", "value"),
    })
    value = F.when(F.col("leaf") == "context_length", whole_number(F.col("text"))).otherwise(F.nullif(F.trim("text"), F.lit("")))
    # The root's key is the start of any key below it, however deep the member was delivered.
    key = F.substring_index("parent_key", "/", 1).try_cast("bigint").alias("payload_id")
    rows = found.select(key, F.col("leaf").alias("field_name"), F.col("ordinal").alias("item_pos"), value.alias("found_value"))
    return rows.where("found_value is not null").distinct()
