"""Scalar functions of catalog records as column expressions; none leaves the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: States of a value that may be absent: no claim, an explicit null, a known value.
MISSING, UNKNOWN, KNOWN = 0, 1, 2


def mapped(value: Column, table: Mapping[str, str], default: Column | None = None) -> Column:
    """The entry of a fixed table for a text, else `default`."""
    lookup = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    found = lookup[value]
    return found if default is None else F.coalesce(found, default)


def fold(text: Column) -> Column:
    """Trimmed lower case, the form in which enumerations are compared."""
    return F.lower(F.trim(text))


def blank_as_null(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def zero_as_null(number: Column) -> Column:
    return F.when(number != 0, number)


#: An RFC 3339 time with the ranges that Go's time.Parse checks; its day is checked on its own.
_RFC3339 = r"^\d{4}-\d{2}-\d{2}T(?:[01]?\d|2[0-3]):[0-5]\d:[0-5]\d(?:[.,]\d+)?(?:Z|[+-](?:[01]\d|2[0-4]):(?:[0-5]\d|60))$"


def parse_date(text: Column) -> Column:
    """A date from ``2024-06-15``, ``2024-06``, ``2024``, an RFC 3339 time (the day as written) or, last, four leading digits above 1900 and below 3000.

    The layouts are strict: blanks around them, impossible days and other orders leave the leading year only.
    """
    first = lambda pattern, tail: F.when(text.rlike(pattern), F.concat(F.substring(text, 1, 10), F.lit(tail)).try_cast("date"))
    year = F.regexp_extract(text, r"^(\d{4})", 1).try_cast("int")
    return F.coalesce(
        first(r"^\d{4}-\d{2}-\d{2}$", ""), first(r"^\d{4}-\d{2}$", "-01"), first(r"^\d{4}$", "-01-01"), first(_RFC3339, ""),
        F.when((year > 1900) & (year < 3000), F.make_date(year, F.lit(1), F.lit(1))),
    )


def any_date(text: Column, *, instants: bool = False) -> Column:
    """A date from ISO dates, year and month, US slashes, month names or, last, a leading plausible year, with blanks around it.

    With `instants` also from RFC 3339 times, whose day is the one written, in the zone written.
    """
    t = F.trim(text)
    year = F.regexp_extract(t, r"^(\d{4})", 1).try_cast("int")
    first = lambda pattern, form: F.when(t.rlike(pattern), F.try_to_timestamp(t, F.lit(form))).cast("date")
    written = [F.when(t.rlike(_RFC3339), F.try_to_timestamp(F.substring(t, 1, 10), F.lit("yyyy-MM-dd"))).cast("date")] if instants else []
    return F.coalesce(
        first(r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
        first(r"^\d{4}-\d{2}$", "yyyy-MM"),
        *written,
        first(r"^\d{2}/\d{2}/\d{4}$", "MM/dd/yyyy"),
        first(r"^[A-Z][a-z]+ \d{1,2}, \d{4}$", "MMMM d, yyyy"),
        first(r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"),
        F.when((year > 1900) & (year < 3000), F.try_to_timestamp(F.concat(year.cast("string"), F.lit("-01-01")), F.lit("yyyy-MM-dd")).cast("date")),
    )


def epoch_seconds(*times: Column) -> Column:
    """Seconds since 1970 of the first of the timestamps that is known, else 0."""
    return F.coalesce(*(F.unix_micros(t.cast("timestamp")) for t in times), F.lit(0)).__truediv__(F.lit(1_000_000)).cast("bigint")


def lenient_long(value: Column) -> Column:
    """A whole number from a number or text, 0 where it is none."""
    return F.coalesce(value.try_cast("double").try_cast("bigint"), F.lit(0))


def optional_double(value: Column) -> Column:
    return F.trim(value.cast("string")).try_cast("double")


def cleaned_tags(tags: Column) -> Column:
    """Trimmed tags without the empty ones."""
    return F.filter(F.transform(tags, lambda x: F.trim(x)), lambda x: x != "")


def known_values(values: Column, allowed: Sequence[str]) -> Column:
    """Lower-case values of an array that an enumeration has, in their order."""
    return F.filter(F.transform(values, fold), lambda x: x.isin(*allowed))


def ordered_union(*arrays: Column) -> Column:
    """The distinct non-empty values of several arrays, each at its first place."""
    joined = F.concat(*(F.coalesce(a, F.array().cast("array<string>")) for a in arrays))
    return F.array_distinct(F.filter(joined, lambda x: x.isNotNull() & (x != "")))


def ranked(values: Column, order: Sequence[str]) -> Column:
    """Values of an array in a given order, others behind it by name."""
    places = {v: i for i, v in enumerate(order)}
    lookup = F.create_map(*(F.lit(x) for pair in places.items() for x in pair))
    keyed = F.transform(values, lambda x: F.struct(F.coalesce(lookup[x], F.lit(len(order))).alias("r"), x.alias("v")))
    return F.transform(F.array_sort(keyed), lambda x: x["v"])


def flag_names(flags: Mapping[str, Column]) -> Column:
    """The names of the flags that are true, in the order given."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in flags.items())))


def last_path_part(name: Column, marker: str) -> Column:
    """The text behind `marker`, else behind the last slash."""
    return F.when(F.instr(name, marker) > 0, F.substring_index(name, marker, -1)).otherwise(F.substring_index(name, "/", -1))


def part_after(name: Column, segment: str) -> Column:
    """The path segment that follows `segment`, null where there is none."""
    return F.nullif(F.regexp_extract(name, rf"(?:^|/){segment}/([^/]+)", 1), F.lit(""))


def split_variant(slug: Column) -> Column:
    """(base, variant) of ``base:variant``; both null where there is more than one colon."""
    parts = F.split(slug, ":", -1)
    fine = F.size(parts) <= 2
    return F.struct(F.when(fine, F.get(parts, F.lit(0))).alias("base"), F.when(fine, F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("variant"))


def definition_parts(identity: Column) -> Column:
    """(owner, slug) of ``owner/slug``, null where there isn't exactly one slash between two parts."""
    parts = F.split(identity, "/", -1)
    fine = (F.size(parts) == 2) & (F.trim(F.get(parts, F.lit(0))) != "") & (F.trim(F.get(parts, F.lit(1))) != "")
    return F.when(fine, F.struct(F.get(parts, F.lit(0)).alias("owner"), F.get(parts, F.lit(1)).alias("slug")))


#: Ids under which owners were known before; they count only as they are written here.
OWNER_ALIASES = {
    "canopylabs": "canopy-labs",
    "huggingfaceh4": "huggingface",
    "llama": "meta",
    "moonshot": "moonshot-ai",
    "moonshotai": "moonshot-ai",
    "togetherai": "together",
    "zhipuai": "zhipu-ai",
}


def owner_id(name: Column) -> Column:
    """The id a name stands for: that of an earlier id, else lower case without blanks around it and with hyphens for those inside; unknown for an empty or null name."""
    folded = F.regexp_replace(F.lower(F.regexp_replace(name, r"^\s+|\s+$", "")), " ", "-")
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("unknown")).otherwise(mapped(name, OWNER_ALIASES, folded))


def resource_id(scope: Column, identity: Column) -> Column:
    """Both parts escaped and joined by a slash, so that they can be told apart again."""
    return F.concat_ws("/", F.url_encode(scope), F.url_encode(identity))


def resource_parts(resource: Column) -> Column:
    """Inverse of resource_id; null where the text isn't one."""
    parts = F.split(resource, "/", -1)
    pair = F.struct(F.try_url_decode(F.get(parts, F.lit(0))).alias("scope"), F.try_url_decode(F.get(parts, F.lit(1))).alias("identity"))
    return F.when((F.size(parts) == 2) & (resource_id(pair["scope"], pair["identity"]) == resource), pair)


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and one spelling for equal numbers, null for invalid text."""
    return F.to_json(F.try_parse_json(text))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of parts joined by NUL; nulls count as empty."""
    return F.sha2(F.concat_ws("\u0000", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def presence(value: Column, claimed: Column) -> Column:
    """struct(value, state): missing without a claim, unknown for a claimed null, else known."""
    state = F.when(~F.coalesce(claimed, F.lit(False)), MISSING).when(value.isNull(), UNKNOWN).otherwise(KNOWN)
    return F.struct(value.alias("value"), state.cast("tinyint").alias("state"))


def json_presence(record: Column, path: str, kind: str) -> Column:
    """The presence of a member of a variant: a missing member and an explicit null are told apart."""
    inner = F.try_variant_get(record, path, "variant")
    return F.struct(
        F.try_variant_get(record, path, kind).alias("value"),
        F.when(inner.isNull(), MISSING).when(F.is_variant_null(inner), UNKNOWN).otherwise(KNOWN).cast("tinyint").alias("state"),
    )


def implied_presence(value: Column, state: Column) -> Column:
    """A true or non-zero value without a claim is known; a false or zero one is missing."""
    implied = F.when(F.coalesce(value.cast("bigint"), F.lit(0)) != 0, KNOWN).otherwise(MISSING)
    return F.coalesce(F.when(state > MISSING, state), implied).cast("tinyint")


def any_known(*claims: Column) -> Column:
    """True if one is; false only if all are known; else unknown."""
    anyone = [F.coalesce(c, F.lit(False)) for c in claims]
    everyone = [c.isNotNull() for c in claims]
    return F.when(_fold(anyone, "or"), True).when(_fold(everyone, "and"), False)


def all_known(*claims: Column) -> Column:
    """False if one is; true only if all are known; else unknown."""
    someone = [~F.coalesce(c, F.lit(True)) for c in claims]
    everyone = [c.isNotNull() for c in claims]
    return F.when(_fold(someone, "or"), False).when(_fold(everyone, "and"), True)


def _fold(conditions: Sequence[Column], how: str) -> Column:
    result = conditions[0]
    for c in conditions[1:]:
        result = result | c if how == "or" else result & c
    return result


def snapped(value: Column, scale: float, tolerance: float = 1e-7) -> Column:
    """A number rounded to the grid of ``1 / scale`` if it lies that close to it already."""
    scaled = value * F.lit(scale)
    grid = F.when(scaled >= 0, F.floor(scaled + 0.5)).otherwise(F.ceil(scaled - 0.5)) / F.lit(scale)
    return F.when(F.abs(grid - value) <= F.abs(value) * tolerance, grid).otherwise(value)


def plain_decimal(value: Column) -> Column:
    """A number in plain decimal digits without trailing zeros."""
    text = F.format_string("%.12f", value.cast("double"))
    return F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")


def thousands(value: Column) -> Column:
    return F.format_number(value, 0)


def short_count(value: Column) -> Column:
    """1.0M, 1.0K or the plain number."""
    return (
        F.when(value >= 1_000_000, F.format_string("%.1fM", value / 1_000_000))
        .when(value >= 1_000, F.format_string("%.1fK", value / 1_000))
        .otherwise(value.cast("string"))
    )


def truncated(text: Column, most: int) -> Column:
    """At most `most` characters, the last three of them dots where something is cut."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, max(0, most - 3)), F.lit("...")))


def effective_at(at: Column, start: Column, end: Column) -> Column:
    """Whether a time lies in the half-open interval [start, end), open where null."""
    return F.coalesce(at >= start, F.lit(True)) & F.coalesce(at < end, F.lit(True))


def violations(rules: Mapping[str, Column]) -> Column:
    """The names of the rules that don't hold; a rule that is null holds."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items())))


# Reasoning, modalities and flags.

#: Levels of reasoning effort by the spellings of sources; ``none`` and others are no level.
LEVELS = {"minimal": "minimum", "minimum": "minimum", "low": "low", "medium": "medium", "high": "high", "max": "maximum", "maximum": "maximum"}
#: What features and parameters that a record lists set as flags.
FEATURE_FLAGS = {
    "tools": ("tools", "tool_calls", "tool_choice"), "tool_use": ("tools", "tool_calls", "tool_choice"), "tool_calls": ("tools", "tool_calls", "tool_choice"),
    "json_mode": ("format_response",), "json_object": ("format_response",),
    "structured_outputs": ("structured_outputs",), "structured_output": ("structured_outputs",), "json_schema": ("structured_outputs",),
    "reasoning": ("reasoning",), "thinking": ("reasoning",),
}
SAMPLING_FLAGS = {n: (n,) for n in ("temperature", "top_p", "top_k", "stop", "frequency_penalty", "presence_penalty", "seed", "logprobs", "top_logprobs")}
#: Tags that tell the modalities: input that is added, output that takes the place of what is there.
TAG_MODALITIES = {
    "embed": ("", "embedding"), "embedding": ("", "embedding"), "stt": ("audio", "text"), "speech_to_text": ("audio", "text"), "tts": ("text", "audio"), "text_to_speech": ("text", "audio"),
    "image-gen": ("", "image"), "text_to_image": ("", "image"), "video-gen": ("", "video"), "text_to_video": ("", "video"),
}


def effort_levels(options: Column) -> Column:
    """The levels of the first option of type ``effort`` in array<struct<type,values,...>>, unknown ones left out; null without one."""
    efforts = F.filter(options, lambda o: F.lower(o["type"]) == "effort")
    return F.array_compact(F.transform(F.get(efforts, F.lit(0))["values"], lambda v: mapped(F.lower(F.trim(v)), LEVELS)))


def token_range(options: Column, kinds: Sequence[str] = ("token", "tokens", "budget", "budget_tokens")) -> Column:
    """struct(min, max) of the first token option of array<struct<type,min,max,...>> with a bound, an open bound being 0; null without one."""
    bound = F.get(F.filter(options, lambda o: F.lower(o["type"]).isin(*kinds) & (o["min"].isNotNull() | o["max"].isNotNull())), F.lit(0))
    return F.when(bound.isNotNull(), F.struct(F.coalesce(bound["min"], F.lit(0)).alias("min"), F.coalesce(bound["max"], F.lit(0)).alias("max")))


def shown_effort(level: Column) -> Column:
    return F.when(level == "minimum", "minimal").otherwise(level)


def modalities_by_tags(inputs: Column, outputs: Column, tags: Column) -> Column:
    """struct(input, output): modalities as tags overrule them, one tag after the other; without tags they stay as they are."""
    known = F.create_map(*(x for t, (i, o) in TAG_MODALITIES.items() for x in (F.lit(t), F.struct(F.lit(i).alias("i"), F.lit(o).alias("o")))))
    told = F.array_compact(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: known[F.lower(t)]))
    none = F.array().cast("array<string>")
    added = F.filter(F.transform(told, lambda t: t["i"]), lambda i: i != "")
    last = F.get(told, F.size(told) - 1)["o"]
    ins = F.when(F.size(added) > 0, F.array_distinct(F.concat(F.coalesce(inputs, none), added))).otherwise(inputs)
    return F.struct(ins.alias("input"), F.when(F.size(told) > 0, F.array(last)).otherwise(outputs).alias("output"))


def flags_of(names: Column, table: Mapping[str, Sequence[str]]) -> Column:
    """The flags that names stand for, whatever their case, without repeats in the order of the names; unknown names set none."""
    lookup = F.create_map(*(x for n, flags in table.items() for x in (F.lit(n), F.array(*map(F.lit, flags)))))
    return F.array_distinct(F.flatten(F.array_compact(F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: lookup[F.lower(n)]))))


def feature_label(inputs: Column, outputs: Column, flags: Mapping[str, Column]) -> Column:
    """A comma list of what a model can do beyond text; empty for nothing."""
    has = lambda c, v: F.coalesce(F.array_contains(c, v), F.lit(False))
    shown = {"vision": has(inputs, "image"), "audio_input": has(inputs, "audio"), "audio_output": has(outputs, "audio")}
    shown |= {n: F.coalesce(flags[n], F.lit(False)) for n in ("tool_calls", "web_search", "reasoning") if n in flags}
    return F.array_join(flag_names(shown), ", ")


#: Paths of a change report that are named otherwise in the evidence, and what enriches a model.
EVIDENCE_PATHS = {"Delivery": "response", "ReasoningTokens": "reasoning_tokens"}
ENRICHED_BELOW = ("features", "pricing", "limits", "metadata")
ENRICHED = ("description", "attachments", "generation", "reasoning", "reasoning_tokens", "verbosity", "tools", "response")


def normal_path(path: Column) -> Column:
    """The path of evidence as change reports name it."""
    return mapped(path, EVIDENCE_PATHS, F.lower(path))


def is_enrichment(path: Column) -> Column:
    """Whether a changed path is one that sources beside the provider enrich."""
    below = F.lit(False)
    for p in ENRICHED_BELOW:
        below = below | F.startswith(path, F.lit(p))
    return path.isin(*ENRICHED) | below


def covers(field: Column, path: Column) -> Column:
    """Whether evidence of a field and a changed path are the same or one lies below the other."""
    f, p = normal_path(field), normal_path(path)
    return (f == p) | F.startswith(p, F.concat(f, F.lit("."))) | F.startswith(f, F.concat(p, F.lit(".")))
