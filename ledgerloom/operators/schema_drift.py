"""Schemas that drift between files of a feed.

Tagged-union inference: every record is read into (path, kind, value) leaves, the kinds of a path
within a file fuse into one set, and neighbouring files are compared by these sets.  A path whose
kind varies keeps a typed branch for each kind beside its canonical value.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import bounded_side, durable
from .nested_tables import _reject

#: Bits of the kinds in a tagged union.
KINDS = {"boolean": 1, "integer": 2, "decimal": 4, "string": 8, "array": 16}

_LEAVES = "feed_id bigint, file_no int, record_id bigint, id string, path string, kind int, value string, same string"


_PLAIN = json.JSONEncoder(ensure_ascii=False).encode
_SORTED = json.JSONEncoder(ensure_ascii=False, sort_keys=True).encode


class _Number(str):
    """The text of a JSON number with a fraction or exponent."""


def canonical(value: object) -> str:
    """A value without regard to kind or case: 131072, 131072.0 and "131072" are one, and so are true and "True"."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, str):
        if not (value[:1].isdigit() or value[:1] in "+-."):  # no number starts otherwise
            return value.lower()
        try:
            n = Decimal(value) if value.strip() == value and "_" not in value else None
        except ArithmeticError:
            n = None
        if n is None or not n.is_finite():
            return value.lower()
        return format(n.normalize(), "f") if -400 < n.adjusted() < 400 and n else "0" if not n else value.lower()
    return _SORTED(value).lower()


def leaves_of(text: str | None, *, nulls: bool = False, wanted: frozenset[str] | None = None) -> Iterator[tuple[str, int, str | None, str | None]] | None:
    """(dotted path, kind, text, canonical value) of each value of a record that is neither null nor an object.

    None if the text is no valid JSON object.  With `nulls` an explicit null is a leaf of kind 0.
    """
    record = _record(text)
    return None if record is None else _walk(record, nulls, wanted)


def _record(text: str | None) -> dict | None:
    """The JSON object of a text; None if it is no valid one."""
    if text is None:
        return None
    try:
        record = json.loads(text, parse_constant=_reject, parse_float=_Number)
    except (ValueError, RecursionError):
        return None
    return record if isinstance(record, dict) else None


def _walk(record: dict, nulls: bool, wanted: frozenset[str] | None = None) -> Iterator[tuple[str, int, str | None, str | None]]:
    open_ = [("", record)]
    while open_:
        prefix, inner = open_.pop()
        for name, value in inner.items():
            path = f"{prefix}{name}"
            if isinstance(value, dict):
                open_.append((f"{path}.", value))
            elif wanted is not None and path not in wanted:
                continue
            elif isinstance(value, bool):
                yield path, KINDS["boolean"], canonical(value), canonical(value)
            elif isinstance(value, int):
                yield path, KINDS["integer"], str(value), str(value)
            elif isinstance(value, _Number):
                yield path, KINDS["decimal"], str(value), canonical(value)
            elif isinstance(value, str):
                yield path, KINDS["string"], value, canonical(value)
            elif isinstance(value, list):
                yield path, KINDS["array"], _PLAIN(value), canonical(value)
            elif nulls:
                yield path, 0, None, None


def _digest(text: str | None) -> str | None:
    """A text, or its 128-bit hash where that is shorter."""
    return text if text is None or len(text) <= 32 else hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def leaves(payloads: DataFrame, *, payload: str = "payload", nulls: bool = False, short: bool = False, wanted: frozenset[str] | None = None) -> DataFrame:
    """The leaves of all readable records, one row each; Python reads each Arrow batch of texts once.

    A path names no row of its own where a record holds null, unless `nulls` asks for it; a readable
    record without any leaf gives one row with a null path, so that it still counts as a record of its file.
    """
    columns = ["feed_id", "file_no", "record_id", payload]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for feed, file, record, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = leaves_of(text, nulls=nulls, wanted=wanted)
                if found is None:
                    continue
                found = list(found)
                model = next((v for p, _, v, _ in found if p == "id"), None)
                if short:
                    found = [(p, k, None, _digest(c)) for p, k, _, c in found]
                rows += [(feed, file, record, model, *leaf) for leaf in found] or [(feed, file, record, None, None, None, None, None)]
                if len(rows) > 50_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    picked = payloads.select(*columns).where("feed_id is not null and file_no is not null")
    return picked.mapInArrow(read, _LEAVES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
    names = [c.split()[0] for c in _LEAVES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


#: Paths that have a member of their own; with more of them, names are data, and the rarer ones share a map.
MOST_PATHS = 5_000

#: Parts that a file's records are dealt into where they have to move to meet what is known of the file.
SALTS = 16


def file_kinds(payloads: DataFrame, *, payload: str = "payload") -> DataFrame:
    """(feed_id, file_no, path, kinds): the tagged union of each path of each file, 0 where it is always null, and a row with a null path for each file.

    Python reads each text once and fuses the kinds of a batch before they leave the worker; the rest
    fuses before the shuffle.  A file without readable records has the row with the null path only.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files: dict[tuple, dict[str | None, int]] = {}
            for feed, file, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = files.get((feed, file))
                if found is None:
                    found = files[feed, file] = {None: 0}
                for path, kind in kinds_of(text):
                    found[path] = found.get(path, 0) | kind
            if files:
                rows = [(feed, file, path, kind) for (feed, file), found in files.items() for path, kind in found.items()]
                types = [pa.int64(), pa.int32(), pa.string(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["feed_id", "file_no", "path", "kinds"])

    picked = payloads.select("feed_id", "file_no", payload).where("feed_id is not null and file_no is not null")
    return picked.mapInArrow(read, "feed_id bigint, file_no int, path string, kinds int").groupBy("feed_id", "file_no", "path").agg(F.bit_or("kinds").alias("kinds"))


_BITS = {bool: KINDS["boolean"], int: KINDS["integer"], _Number: KINDS["decimal"], str: KINDS["string"], list: KINDS["array"], type(None): 0}


def kinds_of(text: str | None) -> Iterator[tuple[str, int]]:
    """(dotted path, kind) of each value of a record that is no object, 0 for null; nothing if the text is no valid JSON object."""
    record = _record(text)
    open_ = [("", record)] if record else []
    while open_:
        prefix, inner = open_.pop()
        for name, value in inner.items():
            if isinstance(value, dict):
                open_.append((f"{prefix}{name}.", value))
            else:
                yield prefix + name, _BITS[type(value)]


def schema_changes(payloads: DataFrame, *, share: float = 0.9, kinds: DataFrame | None = None) -> DataFrame:
    """Rows (feed_id, file_no, field_name, change_kind) of each file against the one before it of its feed.

    A field is the dotted path to values that are no objects; it belongs to a file if a readable
    record holds it with a value other than null.  `change_kind` is `added`, `removed`, `renamed` or
    `retyped`.  A field that is gone and one that has come are a rename if at least `share` of the
    ids that held the old one and are in the new file, at least one, hold the same value in the new
    one; gone fields choose in alphabetical order, each the first that fits.

    Cases: rows with a null feed or file number don't count; a file whose records are all unreadable
    has no fields; the first file of a feed gives no rows; a single record may hold an id more than
    once in a file, then any of its values counts; repeated rows change nothing; an empty table gives
    no rows; other columns are never read.

    The texts are read once for the kinds of all files.  What comes of it, a row for each path of a
    file, is kept; only the files of a pair with fields both gone and come are read again, for the
    values of just these fields.  `kinds` saves the first reading where file_kinds() has been kept.
    """
    fields, renames = _compared(payloads, durable(file_kinds(payloads)) if kinds is None else kinds, share)
    gone = renames.select("feed_id", "_pair", F.col("_old").alias("path"), F.lit("gone").alias("_part"), "_fresh", F.lit(None).cast("int").alias("_was"))
    moved = renames.join(fields.select("feed_id", "_pair", F.col("path").alias("_old"), F.col("_then").alias("_was")), ["feed_id", "_pair", "_old"])
    come = moved.select("feed_id", "_pair", F.col("_fresh").alias("path"), F.lit("come").alias("_part"), "_fresh", "_was")
    told = fields.join(gone.unionAll(come), ["feed_id", "_pair", "path"], "left").where("_part is null or _part = 'come'")
    kinds = (
        F.when(F.col("_part").isNotNull(), F.when(F.col("_was") == F.col("_now"), F.array(F.lit("renamed"))).otherwise(F.array(F.lit("renamed"), F.lit("retyped"))))
        .when(F.col("_then").isNull(), F.array(F.lit("added")))
        .when(F.col("_now").isNull(), F.array(F.lit("removed")))
        .otherwise(F.array(F.lit("retyped")))
    )
    return told.select("feed_id", F.col("_pair").alias("file_no"), F.col("path").alias("field_name"), F.explode(kinds).alias("change_kind"))


def renamed_fields(payloads: DataFrame, *, share: float = 0.9, kinds: DataFrame | None = None) -> DataFrame:
    """(old, fresh): the fields that schema_changes() finds renamed anywhere, each pair once."""
    _, renames = _compared(payloads, durable(file_kinds(payloads)) if kinds is None else kinds, share)
    return renames.select(F.col("_old").alias("old"), F.col("_fresh").alias("fresh")).distinct()


def _compared(payloads: DataFrame, union: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """The fields (feed_id, _pair, _before, path, _now, _then) that differ between neighbouring files, and which of them were renamed."""
    order = Window.partitionBy("feed_id").orderBy("file_no")
    files = union.where("path is null").select("feed_id", "file_no", F.lag("file_no").over(order).alias("_before"), F.lead("file_no").over(order).alias("_after"))
    side = F.explode(F.array(F.struct(F.when(F.col("_before").isNotNull(), F.col("file_no")).alias("no"), F.lit(True).alias("new")), F.struct(F.col("_after").alias("no"), F.lit(False).alias("new"))))
    sided = union.where("kinds > 0").join(files, ["feed_id", "file_no"]).withColumn("_side", side).where("_side.no is not null")
    fields = sided.groupBy("feed_id", F.col("_side.no").alias("_pair"), "path").agg(
        F.max(F.when(F.col("_side.new"), F.col("kinds"))).alias("_now"), F.max(F.when(~F.col("_side.new"), F.col("kinds"))).alias("_then"),
        F.max(F.when(~F.col("_side.new"), F.col("file_no"))).alias("_old_file"),
    )
    fields = fields.where("_now is null or _then is null or _now <> _then").join(files.select("feed_id", F.col("file_no").alias("_pair"), "_before"), ["feed_id", "_pair"])
    fields = durable(fields.select("feed_id", "_pair", "_before", "path", "_now", "_then"))
    return fields, _renames(payloads, fields, share)


def _met(big: DataFrame, small: DataFrame, keys: list[str], salt: Column) -> DataFrame:
    """`big` joined with `small`, which is broadcast where it is proven small; else both are dealt into salted parts, so that no key is one task."""
    side = bounded_side(small)
    if side is not small:
        return big.join(side, keys)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("_salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"]).drop("_salt")


def _renames(payloads: DataFrame, fields: DataFrame, share: float) -> DataFrame:
    """(feed_id, _pair, _old, _fresh) of the fields renamed from one file to the next."""
    loose = fields.where("_now is null or _then is null")
    ripe = loose.groupBy("feed_id", "_pair").agg(F.max("_before").alias("_before"), F.max(F.col("_now").isNull()).alias("_g"), F.max(F.col("_then").isNull()).alias("_c")).where("_g and _c")
    ends = F.explode(F.array(F.struct(F.col("_pair").alias("no"), F.lit(True).alias("new")), F.struct(F.col("_before").alias("no"), F.lit(False).alias("new"))))
    ends = ripe.select("feed_id", "_pair", ends.alias("_end")).select("feed_id", F.col("_end.no").alias("file_no"), "_pair", F.col("_end.new").alias("_new"))
    picked = payloads.select("feed_id", "file_no", "record_id", "payload")
    paths = {r.path for r in loose.select("path").distinct().limit(MOST_PATHS + 1).collect()}
    wanted = frozenset(paths | {"id"}) if len(paths) <= MOST_PATHS else None
    met = _met(picked, ends.select("feed_id", "file_no").distinct(), ["feed_id", "file_no"], F.xxhash64("record_id", "payload"))
    read = leaves(met, short=True, wanted=wanted).where("id is not null")
    # Of the values only those of the fields in question are kept, beside one row for each id of a newer file.
    asked = loose.join(ripe.select("feed_id", "_pair"), ["feed_id", "_pair"]).select(
        "feed_id", F.when(F.col("_now").isNull(), F.col("_before")).otherwise(F.col("_pair")).alias("file_no"), "path", "_pair", F.col("_then").isNull().alias("_new")
    )
    there = ends.where("_new").select("feed_id", "file_no", F.lit("id").alias("path"), "_pair", F.lit(None).cast("boolean").alias("_new"))
    held = _met(read.select("feed_id", "file_no", "id", "path", "same"), asked.unionAll(there).distinct(), ["feed_id", "file_no", "path"], F.xxhash64("id"))
    held = durable(held.select("feed_id", "_pair", "id", "path", "same", "_new").repartition("feed_id", "_pair", "id"))  # read in two ways below
    # Of each id: the gone fields it held and whether the newer file has it; then, of each of its values, the fields with it on both sides.
    old = F.collect_set(F.when(~F.col("_new"), F.col("path")))
    ids = held.groupBy("feed_id", "_pair", "id").agg(F.max(F.col("_new").isNull() | F.col("_new")).alias("_there"), old.alias("_xs")).where("_there")
    total = ids.select("feed_id", "_pair", F.explode("_xs").alias("_old")).groupBy("feed_id", "_pair", "_old").agg(F.count(F.lit(1)).alias("_ids"))
    shared = held.where("_new is not null").groupBy("feed_id", "_pair", "id", "same").agg(old.alias("_xs"), F.collect_set(F.when(F.col("_new"), F.col("path"))).alias("_ys"))
    shared = shared.where("size(_xs) > 0 and size(_ys) > 0").select("feed_id", "_pair", "id", F.explode("_xs").alias("_old"), "_ys")
    shared = shared.select("feed_id", "_pair", "id", "_old", F.explode("_ys").alias("_y")).distinct()
    equal = shared.groupBy("feed_id", "_pair", "_old", "_y").agg(F.count(F.lit(1)).alias("_equal"))
    good = equal.join(total, ["feed_id", "_pair", "_old"]).where(F.col("_equal") >= F.col("_ids") * F.lit(share) - F.lit(1e-9))
    options = good.groupBy("feed_id", "_pair", "_old").agg(F.sort_array(F.collect_list("_y")).alias("_ys"))
    chosen = options.groupBy("feed_id", "_pair").agg(F.sort_array(F.collect_list(F.struct("_old", "_ys"))).alias("_all"))
    # A fold over the gone fields in order; each takes its first fitting field that is still free.
    start = F.array().cast("array<struct<o:string,n:string>>")

    def take(taken: Column, option: Column) -> Column:
        free = F.filter(option["_ys"], lambda y: ~F.exists(taken, lambda t: t["n"] == y))
        return F.when(F.size(free) > 0, F.concat(taken, F.array(F.struct(option["_old"].alias("o"), F.get(free, F.lit(0)).alias("n"))))).otherwise(taken)

    folded = chosen.select("feed_id", "_pair", F.explode(F.aggregate("_all", start, take)).alias("_r"))
    return folded.select("feed_id", "_pair", F.col("_r.o").alias("_old"), F.col("_r.n").alias("_fresh"))


#: Spellings of the two fields that are compared above all, the preferred first; others are derived from the renames.
EFFORT = ("capabilities.effort.supported", "capabilities.reasoning_effort.supported", "capabilities.effort", "supports_effort")
CONTEXT = ("max_model_len", "maxModelLen", "context_window", "contextWindow", "limits.context_window", "context_length")


#: Column types of the typed branches; arrays stay JSON text.
BRANCHES = {"boolean": "boolean", "integer": "bigint", "decimal": "double", "string": "string", "array": "string"}

def inferred(kinds: DataFrame, most: int = MOST_PATHS) -> tuple[dict[str, int], bool]:
    """The fused schema of file_kinds(): each path with the bits of all kinds met, 0 for one that is always null; and whether there are more.

    Of more than `most` paths those in the most files are taken, by name among equals.
    """
    fused = kinds.where("path is not null").groupBy("path").agg(F.bit_or("kinds").alias("kinds"), F.count(F.lit(1)).alias("files"))
    rows = fused.orderBy(F.col("files").desc(), "path").limit(most + 1).collect()
    return {r.path: r.kinds for r in sorted(rows[:most], key=lambda r: r.path)}, len(rows) > most


def _same_field(renames: DataFrame | None, spellings: tuple[str, ...], known: Iterable[str]) -> tuple[str, ...]:
    """`spellings`, then all paths of `known` that renames link to one of them."""
    known, links = set(known), {}
    for old, fresh in renames.toLocalIterator() if renames is not None else ():
        if old in known and fresh in known:
            links.setdefault(old, set()).add(fresh)
            links.setdefault(fresh, set()).add(old)
    found, open_ = set(spellings), list(spellings)
    while open_:
        more = links.get(open_.pop(), set()) - found
        found |= more
        open_ += more
    return (*spellings, *sorted(found - set(spellings)))


def field_names(paths: Iterable[str]) -> dict[str, str]:
    """A member name for each path: the path, with a number behind it where another differs in case only."""
    paths, names, taken = [*paths], {}, set()
    reserved = {p.lower() for p in paths}
    for path in paths:
        name, n = path or "(empty)", 1
        while name.lower() in taken or (n > 1 or not path) and name.lower() in reserved:
            n += 1
            name = f"{path or '(empty)'}~{n}"
        taken.add(name.lower())
        names[path] = name
    return names


def unified(payloads: DataFrame, *, effort: tuple[str, ...] = EFFORT, context: tuple[str, ...] = CONTEXT, most_paths: int = MOST_PATHS, renames: bool = True, fields: bool = True) -> DataFrame:
    """One consistent table of all readable records, whatever fields their files used.

    Columns: feed_id, file_no, record_id, id; `effort_supported boolean` and `context_limit bigint`,
    the canonical values; for each the path it came from and the typed branches of its tagged union
    (`..._boolean`, `..._integer`, `..._decimal`, `..._string`), of which one is set; and `fields`, the
    fused schema of all paths met in any record, with a member for each path under its dotted name.
    A member is a struct of the canonical text `value` and a typed branch for each kind that the path
    was met with (arrays as JSON text).  It is null where the record lacks the path and a struct of
    nulls where the record holds null; a path that is null everywhere has `value` only.

    Of several spellings in one record the first of the list holds.  1, "true" and true mean support,
    0, "false" and false none, others null.  A context limit is a whole number in any kind, else
    null.  Records without either field still have a row; repeated rows count once, and where texts of
    one record differ each has a row.  Paths that differ in case only are members of their own, later
    ones with a number (``a``, ``A~2``).  A number that a branch can't hold is null there and whole in
    `value`.  Should a record hold a path twice, a value goes before null, then the first kind.

    `effort` and `context` are the spellings that are known; with `renames`, every path that files of
    the feeds renamed to or from one of them, at any remove, counts as a further one.  Where there are
    more than `most_paths` paths, the rarer ones are in the map `others` with their canonical text.
    Without `fields` only the two canonical values are read from the records.
    """
    kinds = durable(file_kinds(payloads))
    schema, more = inferred(kinds, most_paths)
    pairs = durable(renamed_fields(payloads, kinds=kinds)) if renames and schema else None
    effort, context = _same_field(pairs, effort, schema), _same_field(pairs, context, schema)
    if not fields:
        schema, more = {}, False
    wanted = None if fields else frozenset((*effort, *context, "id"))
    names = field_names(schema)
    keys = ["feed_id", "file_no", "record_id"]
    picked = payloads.select(*keys, "payload").where("feed_id is not null and file_no is not null").distinct()
    leaf = "struct<path:string,kind:int,value:string,same:string>"
    struct = lambda bits: f"struct<value:string{''.join(f',{k}:{BRANCHES[k]}' for k, bit in KINDS.items() if bits & bit)}>"
    shape = f"feed_id bigint, file_no int, record_id bigint, id string, _e {leaf}, _c {leaf}"
    shape += f", fields struct<{','.join(f'`{names[p]}`:{struct(bits)}' for p, bits in schema.items())}>" if schema else ""
    shape += ", others map<string,string>" if more else ""
    rows = picked.mapInArrow(_records(schema, names, effort, context, more, wanted), shape)
    branch = lambda s, kind: F.when(F.col(f"{s}.kind") == KINDS[kind], F.col(f"{s}.value"))
    supported = F.when(F.col("_e.same").isin("true", "1"), True).when(F.col("_e.same").isin("false", "0"), False)
    limit = F.when(F.col("_c.same").rlike(r"^\d{1,18}$"), F.col("_c.same")).try_cast("bigint")
    return rows.select(
        "feed_id", "file_no", "record_id", "id",
        supported.alias("effort_supported"), F.col("_e.path").alias("effort_path"),
        branch("_e", "boolean").try_cast("boolean").alias("effort_boolean"), branch("_e", "integer").try_cast("bigint").alias("effort_integer"), branch("_e", "string").alias("effort_string"),
        limit.alias("context_limit"), F.col("_c.path").alias("context_path"),
        branch("_c", "integer").try_cast("bigint").alias("context_integer"), branch("_c", "decimal").try_cast("double").alias("context_decimal"), branch("_c", "string").alias("context_string"),
        *(["fields"] if schema else []), *(["others"] if more else []),
    )


def _typed(kind: str, text: str | None) -> object:
    """The text of a leaf as the value of its typed branch; null where that can't hold it."""
    if kind == "boolean":
        return text == "true"
    if kind == "integer":
        return n if -(2**63) <= (n := int(text)) < 2**63 else None
    return float(text) if kind == "decimal" else text


_ARROW = {"boolean": pa.bool_(), "integer": pa.int64(), "decimal": pa.float64(), "string": pa.string(), "array": pa.string()}


def _records(schema: dict[str, int], names: dict[str, str], effort: tuple[str, ...], context: tuple[str, ...], more: bool, wanted: frozenset[str] | None = None):  # noqa: ANN202
    """A reader of Arrow batches of records: one row for each readable one, every path of the schema a struct of its typed branches."""
    leaf = pa.struct([("path", pa.string()), ("kind", pa.int32()), ("value", pa.string()), ("same", pa.string())])

    def held_of(text: str | None) -> dict[str, tuple] | None:
        found = leaves_of(text, nulls=True, wanted=wanted)
        if found is None:
            return None
        held: dict[str, tuple] = {}
        for path, kind, value, same in found:  # a path may occur twice, once dotted and once nested
            told = held.get(path)
            if told is None or (kind == 0, kind, value or "") < (told[0] == 0, told[0], told[1] or ""):
                held[path] = (kind, value, same)
        return held

    def first(held: dict[str, tuple], paths: tuple[str, ...]) -> dict | None:
        path = next((p for p in paths if p in held and held[p][0]), None)
        return None if path is None else dict(zip(("path", "kind", "value", "same"), (path, *held[path])))

    def column(path: str, bits: int, rows: list[dict[str, tuple]]) -> pa.Array:
        leaves_ = [h.get(path) for h in rows]
        fields = [("value", pa.array([x and x[2] for x in leaves_], pa.string()))]
        for kind, bit in KINDS.items():
            if bits & bit:
                fields.append((kind, pa.array([_typed(kind, x[1]) if x and x[0] == bit else None for x in leaves_], _ARROW[kind])))
        return pa.StructArray.from_arrays([a for _, a in fields], [n for n, _ in fields], mask=pa.array([x is None for x in leaves_]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kept = [], []
            for i, text in enumerate(batch.column(3).to_pylist()):
                held = held_of(text)
                if held is not None:
                    rows.append(held)
                    kept.append(i)
            if not rows:
                continue
            taken = [batch.column(i).take(pa.array(kept)) for i in range(3)]
            identity = pa.array([(h["id"][1] if "id" in h else None) for h in rows], pa.string())
            columns = [*taken, identity, pa.array([first(h, effort) for h in rows], leaf), pa.array([first(h, context) for h in rows], leaf)]
            labels = ["feed_id", "file_no", "record_id", "id", "_e", "_c"]
            if schema:
                columns.append(pa.StructArray.from_arrays([column(p, bits, rows) for p, bits in schema.items()], [names[p] for p in schema]))
                labels.append("fields")
            if more:
                columns.append(pa.array([[(p, x[2]) for p, x in h.items() if p not in schema] for h in rows], pa.map_(pa.string(), pa.string())))
                labels.append("others")
            yield pa.RecordBatch.from_arrays(columns, labels)

    return read
