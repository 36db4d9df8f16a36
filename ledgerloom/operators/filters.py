"""Filters, searches, sorts and pages of catalog relations.

A filter is a plain Python object that builds one Column, so that the optimizer sees ordinary
predicates and pushes them to the scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import all_of

#: What a filter may sort by, and the flags and states it may ask for.
SORTS = ("id", "name", "release_date", "context_window", "created_at", "updated_at")
FLAGS = ("streaming", "tool_calls", "tools", "tool_choice", "reasoning", "temperature", "max_tokens")
MODALITIES = ("text", "audio", "image", "video", "pdf", "embedding")
STATES = ("active", "beta", "preview", "deprecated", "unknown")
MOST_ROWS = 1000


def contains_all(values: Column, wanted: Sequence[str]) -> Column:
    """Whether an array has all wanted values, whatever their case; a null array has none."""
    lower = F.transform(values, F.lower)
    return all_of(*(F.coalesce(F.array_contains(lower, w.lower()), F.lit(False)) for w in wanted))


def contains_any(values: Column, wanted: Sequence[str]) -> Column:
    """Whether an array has one of the wanted values, whatever their case; a null array has none."""
    return F.coalesce(F.arrays_overlap(F.transform(values, F.lower), F.array(*(F.lit(w.lower()) for w in wanted))), F.lit(False))


def in_range(value: Column, low: int = 0, high: int = 0) -> Column:
    """Inclusive bounds of which 0 is none; where one is set, missing values and those not above 0 fail."""
    if not low and not high:
        return F.lit(True)
    bounds = [value > 0, *([value >= low] if low else []), *([value <= high] if high else [])]
    return F.coalesce(all_of(*bounds), F.lit(False))


def at_most_or_missing(value: Column, most: float) -> Column:
    """Whether a value is at most `most`; a missing one passes."""
    return F.coalesce(value <= most, F.lit(True))


def search(query: str, *texts: Column, arrays: Iterable[Column] = ()) -> Column:
    """Case-insensitive substring of any of the texts or array elements; an empty query matches all."""
    if not query:
        return F.lit(True)
    q = F.lit(query.lower())
    hits = [F.coalesce(F.contains(F.lower(t), q), F.lit(False)) for t in texts]
    hits += [F.coalesce(F.exists(a, lambda x: F.contains(F.lower(x), q)), F.lit(False)) for a in arrays]
    result = F.lit(False)
    for h in hits:
        result = result | h
    return result


def matches_capability(capability: str, flags: Mapping[str, Column], inputs: Column) -> Column:
    """Whether a model has a capability: tools by either flag, vision by its input; an unknown name and missing features never."""
    flag = lambda n: F.coalesce(flags[n], F.lit(False)) if n in flags else F.lit(False)
    name = capability.lower()
    if name in ("tool_calls", "tools"):
        return flag("tool_calls") | flag("tools")
    if name in ("reasoning", "streaming"):
        return flag(name)
    if name in ("vision", "image"):
        return F.coalesce(F.array_contains(inputs, "image"), F.lit(False))
    return F.lit(False)


def glob_regex(pattern: str, *, across: bool = False) -> str:
    """An anchored regular expression for a glob; ``*`` and ``?`` don't cross a slash unless `across`."""
    one = "." if across else "[^/]"
    special = {"*": f"{one}*", "?": one}
    return "^" + "".join(special.get(c, re.escape(c)) for c in pattern) + "$"


def matches_glob(text: Column, pattern: str, *, fold_case: bool = True) -> Column:
    return F.lower(text).rlike(glob_regex(pattern.lower())) if fold_case else text.rlike(glob_regex(pattern))


def matches_field(name: Column, patterns: Sequence[str]) -> Column:
    """Whether a field name fits one of the globs; ``prefix.*`` takes all below the prefix; no pattern takes all."""
    result = F.lit(not patterns)
    for p in patterns:
        below = F.startswith(F.lower(name), F.lit(p[:-1].lower())) if p.endswith(".*") else F.lit(False)
        result = result | below | F.lower(name).rlike(glob_regex(p.lower(), across=True))
    return result


@dataclass(frozen=True)
class Relation:
    """Where a filter finds its values: a column for each logical name, null where the relation has none."""

    id: Column
    name: Column | None = None
    status: Column | None = None
    input_modalities: Column | None = None
    output_modalities: Column | None = None
    flags: Mapping[str, Column] = field(default_factory=dict)
    tags: Column | None = None
    open_weights: Column | None = None
    context_window: Column | None = None
    input_tokens: Column | None = None
    output_tokens: Column | None = None
    release_date: Column | None = None
    created_at: Column | None = None
    updated_at: Column | None = None

    def get(self, name: str, kind: str) -> Column:
        value = getattr(self, name)
        return F.lit(None).cast(kind) if value is None else value


@dataclass(frozen=True)
class ModelFilter:
    """A conjunction of optional predicates with a sort and a page; unset members don't filter."""

    id: str = ""
    name: str = ""
    name_contains: str = ""
    status: str = ""
    modality_input: tuple[str, ...] = ()
    modality_output: tuple[str, ...] = ()
    features: Mapping[str, bool] = field(default_factory=dict)
    tags: tuple[str, ...] = ()
    open_weights: bool | None = None
    min_context: int = 0
    max_context: int = 0
    min_input: int = 0
    max_input: int = 0
    min_output: int = 0
    max_output: int = 0
    released_after: str = ""
    released_before: str = ""
    ids: tuple[str, ...] = ()
    sort: str = ""
    order: str = ""
    limit: int = 0
    offset: int = 0
    max_results: int = 0

    def validate(self) -> None:
        """Raise ValueError for what no relation could answer."""
        problems = []
        if self.sort and self.sort not in SORTS:
            problems.append(f"sort {self.sort!r}")
        if self.order and (self.order.lower() not in ("asc", "desc") or not self.sort):
            problems.append(f"order {self.order!r}")
        if self.limit and not 1 <= self.limit <= MOST_ROWS or self.offset < 0:
            problems.append("page")
        if not 0 <= self.max_results <= MOST_ROWS:
            problems.append(f"max_results {self.max_results}")
        for low, high in ((self.min_context, self.max_context), (self.min_input, self.max_input), (self.min_output, self.max_output)):
            if low < 0 or high < 0 or high and low > high:
                problems.append(f"range {low} to {high}")
        if self.released_after and self.released_before and self.released_after > self.released_before:
            problems.append("release dates")
        problems += [f"flag {f!r}" for f in self.features if f not in FLAGS]
        problems += [f"modality {m!r}" for m in (*self.modality_input, *self.modality_output) if m.strip().lower() not in MODALITIES]
        if self.status and self.status.lower() not in STATES:
            problems.append(f"status {self.status!r}")
        if problems:
            raise ValueError("invalid filter: " + ", ".join(problems))

    def condition(self, of: Relation) -> Column:
        """All set predicates; a missing nested value fails each predicate that asks for it."""
        tests = []
        strict = lambda c: F.coalesce(c, F.lit(False))
        if self.ids:
            tests.append(strict(of.id.isin(*self.ids)))
        if self.id:
            tests.append(strict(of.id == self.id))
        if self.name:
            tests.append(strict(F.lower(of.get("name", "string")) == self.name.lower()))
        if self.name_contains:
            tests.append(search(self.name_contains, of.get("name", "string")))
        if self.status:
            tests.append(strict(F.lower(of.get("status", "string")) == self.status.lower()))
        if self.modality_input:
            tests.append(contains_all(of.get("input_modalities", "array<string>"), [m.strip() for m in self.modality_input]))
        if self.modality_output:
            tests.append(contains_all(of.get("output_modalities", "array<string>"), [m.strip() for m in self.modality_output]))
        for name, wanted in self.features.items():
            flag = of.flags.get(name, F.lit(None).cast("boolean"))
            tests.append(F.coalesce(flag, F.lit(False)) == F.lit(wanted))
        if self.tags:
            tests.append(contains_any(of.get("tags", "array<string>"), self.tags))
        if self.open_weights is not None:
            tests.append(strict(of.get("open_weights", "boolean") == F.lit(self.open_weights)))
        for name, low, high in (("context_window", self.min_context, self.max_context), ("input_tokens", self.min_input, self.max_input), ("output_tokens", self.min_output, self.max_output)):
            if low or high:
                tests.append(in_range(of.get(name, "bigint"), low, high))
        released = of.get("release_date", "date").cast("date")
        if self.released_after:
            tests.append(strict(released >= F.lit(self.released_after).cast("date")))
        if self.released_before:
            tests.append(strict(released <= F.lit(self.released_before).cast("date")))
        return all_of(*tests) if tests else F.lit(True)

    def keys(self, of: Relation, *ties: Column) -> list[Column]:
        """Sort keys: missing values last in either direction, the id ascending behind them."""
        key = {
            "": None, "id": None, "name": F.nullif(F.lower(of.get("name", "string")), F.lit("")), "release_date": of.get("release_date", "date"),
            "context_window": F.when(of.get("context_window", "bigint") > 0, of.get("context_window", "bigint")),
            "created_at": of.get("created_at", "timestamp"), "updated_at": of.get("updated_at", "timestamp"),
        }[self.sort]
        down = self.order.lower() == "desc"
        if self.sort == "id":
            return [of.id.desc() if down else of.id.asc(), *ties]
        first = [] if key is None else [key.desc_nulls_last() if down else key.asc_nulls_last()]
        return [*first, of.id.asc(), *ties] if first else [*ties, of.id.asc()]

    def apply(self, df: DataFrame, of: Relation, *ties: Column) -> DataFrame:
        """The filtered rows of the page, in order; a limit becomes a top-k without a full sort. `max_results` bounds the list before the page is taken."""
        self.validate()
        rows = df.where(self.condition(of)).orderBy(*self.keys(of, *ties))
        rows = rows.limit(self.max_results) if self.max_results else rows
        rows = rows.offset(self.offset) if self.offset else rows
        return rows.limit(self.limit) if self.limit else rows


def parse_filter(parameters: Mapping[str, str], *, strict: bool = False) -> ModelFilter:
    """A filter from text parameters. Malformed values are ignored, or raise ValueError if `strict`."""
    found: dict[str, object] = {}
    features: dict[str, bool] = {}
    known = {f.name: f for f in fields(ModelFilter)}

    def read(name: str, convert):  # noqa: ANN001, ANN202
        try:
            return convert(parameters[name].strip())
        except (ValueError, KeyError) as problem:
            if strict:
                raise ValueError(f"malformed {name}: {parameters[name]!r}") from problem
            return None

    truth = {"true": True, "1": True, "false": False, "0": False}
    for name, text in parameters.items():
        if name == "feature":
            features |= {f.strip(): True for f in text.split(",") if f.strip()}
        elif name.startswith("feature_"):
            if (value := read(name, lambda t: truth[t.lower()])) is not None:
                features[name[8:]] = value
        elif name == "tag":
            found["tags"] = tuple(t.strip() for t in text.split(",") if t.strip())
        elif name in ("modality_input", "modality_output", "ids"):
            found[name] = tuple(t.strip() for t in text.split(",") if t.strip())
        elif name == "open_weights":
            if (value := read(name, lambda t: truth[t.lower()])) is not None:
                found[name] = value
        elif name in ("released_after", "released_before"):
            value = read(name, lambda t: t if re.fullmatch(r"\d{4}-\d{2}-\d{2}", t) else int("x"))
            if value is not None:
                found[name] = value
        elif name in known and isinstance(known[name].default, int) and not isinstance(known[name].default, bool):
            if (value := read(name, int)) is not None:
                found[name] = value
        elif name in known:
            found[name] = text
        elif strict and name != "provider":
            raise ValueError(f"unknown parameter {name!r}")
    found.setdefault("limit", 100)
    return ModelFilter(**found, features=features)


def page(df: DataFrame, keys: Sequence[Column], limit: int = 0, offset: int = 0) -> tuple[DataFrame, int]:
    """(rows of a page, number of all rows); a limit of 0 or less takes all, a negative offset is 0."""
    rows = df.orderBy(*keys)
    rows = rows.offset(offset) if offset > 0 else rows
    return (rows.limit(limit) if limit > 0 else rows), df.count()
