"""Wire records of provider listings to rows of one model relation.

Every converter is a projection over JSON text: (provider_id, record) in, the same columns out.  Any
further column of the input is passed on, unless it bears the name of one of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cleaned_tags, flag_names, known_values, last_path_part, mapped, part_after

#: Spellings of the same limit, the preferred first.
CONTEXT = ("max_model_len", "context_window", "context_length", "input_token_limit", "max_context_length")
OUTPUT = ("max_completion_tokens", "max_output_length", "output_token_limit", "max_tokens")
MODALITIES = ("text", "audio", "image", "video", "pdf", "embedding")
#: Names of effort levels that differ between listings.
LEVELS = {"minimal": "minimum", "minimum": "minimum", "low": "low", "medium": "medium", "high": "high", "max": "maximum", "maximum": "maximum", "xhigh": "maximum"}
#: States of models; any other text is unknown, none is none.
STATES = {"": "", "active": "active", "beta": "beta", "preview": "preview", "deprecated": "deprecated"}


def _member(record: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(record, f"$.{path}", kind)


def first_present(record: Column, paths: Sequence[str], kind: str) -> Column:
    """The first member of the list that is there and not null; a text that is no number is none."""
    return F.coalesce(*(_member(record, p, kind) for p in paths))


def whole(record: Column, paths: Sequence[str]) -> Column:
    return first_present(record, paths, "double").cast("bigint")


def _parsed(records: DataFrame) -> DataFrame:
    """Every column but the text, with the text as the variant `_r`."""
    others = [c for c in records.columns if c != "record"]
    return records.select(*others, F.explode_outer(F.array(F.try_parse_json("record"))).alias("_r")).where("_r is not null")


def _kept(records: DataFrame) -> list[str]:
    """Columns that a converter passes on as they are, beside the provider."""
    return [c for c in records.columns if c not in ("record", *_COLUMNS)]


_COLUMNS = ("provider_id", "id", "name", "owner", "created", "context_window", "output_tokens", "input_modalities", "capabilities")


def openai_models(records: DataFrame) -> DataFrame:
    """OpenAI-compatible records: limits under any of their spellings, owner by field or by the start of the id."""
    r = F.col("_r")
    identity = _member(r, "id", "string")
    owner = F.coalesce(F.nullif(F.trim(_member(r, "owned_by", "string")), F.lit("")), F.when(F.instr(identity, "/") > 0, F.substring_index(identity, "/", 1)))
    effort = F.coalesce(*(_member(r, p, "boolean") for p in ("capabilities.effort.supported", "capabilities.effort", "supports_effort")))
    return _parsed(records).select(
        *_kept(records), "provider_id", identity.alias("id"), F.coalesce(_member(r, "name", "string"), identity).alias("name"), owner.alias("owner"), whole(r, ["created"]).alias("created"),
        whole(r, CONTEXT).alias("context_window"), whole(r, OUTPUT).alias("output_tokens"), known_values(_member(r, "input_modalities", "array<string>"), MODALITIES).alias("input_modalities"),
        flag_names({"tools": _member(r, "supports_tools", "boolean"), "effort": effort, "batch": _member(r, "capabilities.batch.supported", "boolean")}).alias("capabilities"),
    ).where("id is not null and trim(id) <> ''")


def anthropic_models(records: DataFrame) -> DataFrame:
    """Records whose capabilities are objects with a `supported` member; the context is the input limit."""
    r = F.col("_r")
    supported = lambda n: _member(r, f"capabilities.{n}.supported", "boolean")
    levels = flag_names({LEVELS[n]: supported(f"effort.{n}") for n in ("low", "medium", "high", "max")})
    image = F.when(supported("image_input"), F.array(F.lit("text"), F.lit("image"))).otherwise(F.array(F.lit("text")))
    return _parsed(records).select(
        *_kept(records), "provider_id", _member(r, "id", "string").alias("id"), F.coalesce(_member(r, "display_name", "string"), _member(r, "id", "string")).alias("name"), F.lit("anthropic").alias("owner"),
        F.unix_seconds(_member(r, "created_at", "string").try_cast("timestamp")).alias("created"), whole(r, ["max_input_tokens"]).alias("context_window"), whole(r, ["max_tokens"]).alias("output_tokens"),
        image.alias("input_modalities"), F.concat(flag_names({"batch": supported("batch"), "effort": supported("effort")}), F.transform(levels, lambda x: F.concat(F.lit("effort:"), x))).alias("capabilities"),
    ).where("id is not null and trim(id) <> ''")


def google_models(records: DataFrame) -> DataFrame:
    """Records named by resource path; supported methods tell streaming and embedding."""
    r = F.col("_r")
    path = _member(r, "name", "string")
    methods = F.coalesce(_member(r, "supportedGenerationMethods", "array<string>"), F.array().cast("array<string>"))
    return _parsed(records).select(
        *_kept(records), "provider_id", last_path_part(path, "models/").alias("id"), F.coalesce(_member(r, "displayName", "string"), path).alias("name"), F.coalesce(part_after(path, "publishers"), F.lit("google")).alias("owner"),
        F.lit(None).cast("bigint").alias("created"), whole(r, ["inputTokenLimit"]).alias("context_window"), whole(r, ["outputTokenLimit"]).alias("output_tokens"), F.lit(None).cast("array<string>").alias("input_modalities"),
        flag_names({
            "streaming": F.array_contains(methods, "streamGenerateContent"), "chat": F.array_contains(methods, "generateContent"), "embedding": F.array_contains(methods, "embedContent"),
            "temperature": _member(r, "temperature", "double").isNotNull(), "reasoning": _member(r, "thinking", "boolean"),
        }).alias("capabilities"),
    ).where("id is not null and trim(id) <> ''")


def model_status(text: Column) -> Column:
    """The state a text names, without regard to case and blanks around it; unknown for any other text, empty for none."""
    return mapped(F.lower(F.trim(F.coalesce(text, F.lit("")))), STATES, F.lit("unknown"))


def upstream_models(payloads: DataFrame, payload: str, aliases: DataFrame | None = None) -> DataFrame:
    """The nested map provider → models → record of an upstream index, one row a model.

    With `aliases` (alias, target) providers are renamed to their canonical id and unknown ones left out.
    """
    index = payloads.select(F.explode_outer(F.array(F.try_parse_json(payload))).alias("_i"))
    providers = index.select(F.explode(F.try_variant_get("_i", "$", "map<string,variant>")).alias("provider_id", "_p"))
    if aliases is not None:
        named = aliases.select(F.col("alias").alias("_a"), F.col("target").alias("_t")).where("_t is not null")
        providers = providers.join(named, F.col("provider_id") == F.col("_a")).select(F.col("_t").alias("provider_id"), "_p")
    records = providers.select("provider_id", F.explode(F.try_variant_get("_p", "$.models", "map<string,variant>")).alias("_key", "_r"))
    r = F.col("_r")
    efforts = F.filter(_member(r, "reasoning_options", "array<struct<type:string,values:array<string>>>"), lambda o: o["type"] == "effort")
    levels = F.array_compact(F.transform(F.get(efforts, F.lit(0))["values"], lambda v: mapped(F.lower(v), LEVELS)))
    return records.select(
        "provider_id", F.coalesce(_member(r, "id", "string"), F.col("_key")).alias("id"), _member(r, "name", "string").alias("name"), _member(r, "family", "string").alias("family"),
        model_status(_member(r, "status", "string")).alias("status"), _member(r, "release_date", "string").alias("release_date"),
        whole(r, ["limit.context"]).alias("context_window"), whole(r, ["limit.output"]).alias("output_tokens"), known_values(_member(r, "modalities.input", "array<string>"), MODALITIES).alias("input_modalities"),
        cleaned_tags(_member(r, "tags", "array<string>")).alias("tags"), levels.alias("effort_levels"),
        flag_names({n: _member(r, n, "boolean") for n in ("attachment", "reasoning", "structured_output", "temperature", "tool_call", "open_weights")}).alias("capabilities"),
    ).where("id is not null and trim(id) <> ''")


#: Converters by kind of endpoint.
CONVERTERS = {"openai": openai_models, "anthropic": anthropic_models, "google": google_models, "vertex": google_models}
