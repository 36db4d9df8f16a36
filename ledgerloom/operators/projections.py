"""Detail projections of definitions and offerings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import flag_names, ranked, shown_effort

#: The order in which modalities are shown, and parameters by the flag that supports them.
MODALITY_ORDER = ("text", "image", "file", "audio", "video", "embeddings")
SHOWN = {"pdf": "file", "embedding": "embeddings"}
SPECIAL_TAGS = ("embed", "embedding", "image-gen", "video-gen", "tts", "stt", "rerank", "text_to_image", "text_to_speech", "speech_to_text")
#: Names of parameters in their order, by the flag that supports them where that is named otherwise.
PARAMETERS = (
    "tools", "tool_choice", "web_search_options", "reasoning", "include_reasoning", "reasoning_effort", "verbosity", "temperature", "top_p", "top_k", "top_a", "min_p", "typical_p", "tfs",
    "max_tokens", "max_completion_tokens", "stop", "stop_token_ids", "frequency_penalty", "presence_penalty", "repetition_penalty", "logit_bias", "seed", "logprobs", "top_logprobs", "n", "best_of",
    "response_format", "structured_outputs",
)
PARAMETER_FLAGS = {"web_search_options": "web_search", "max_completion_tokens": "max_output_tokens", "response_format": "format_response"}
#: Parameters with a default, of which two are a limit by themselves.
DEFAULTS = ("temperature", "top_p", "top_k", "top_a", "min_p", "typical_p", "tfs", "max_tokens", "max_completion_tokens", "frequency_penalty", "presence_penalty", "repetition_penalty", "n", "best_of")


def architecture(inputs: Column, outputs: Column, tokenizer: Column) -> Column:
    """struct(input_modalities, output_modalities, modality as ``a+b->c``, tokenizer)."""
    shown = lambda c: ranked(F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<string>")), _shown)), MODALITY_ORDER)
    i, o = shown(inputs), shown(outputs)
    return F.struct(i.alias("input_modalities"), o.alias("output_modalities"), F.concat(F.concat_ws("+", i), F.lit("->"), F.concat_ws("+", o)).alias("modality"), F.coalesce(tokenizer, F.lit("Other")).alias("tokenizer"))


def _shown(value: Column) -> Column:
    result = value
    for k, v in SHOWN.items():
        result = F.when(value == k, v).otherwise(result)
    return result


def supported_parameters(flags: Mapping[str, Column]) -> Column:
    """Names of the parameters whose flag is true, in the order given; empty without flags."""
    return flag_names(flags) if flags else F.array().cast("array<string>")


def default_parameters(ranges: Mapping[str, Column]) -> Column:
    """A map of the defaults that are known; null where none is."""
    pairs = F.array_compact(F.array(*(F.when(c.isNotNull(), F.struct(F.lit(n).alias("key"), c.cast("double").alias("value"))) for n, c in ranges.items())))
    return F.when(F.size(pairs) > 0, F.map_from_entries(pairs))


def parameters_of(features: Column) -> Column:
    """Names of the parameters that a map<string,boolean> of feature flags supports, in their fixed order; empty without any."""
    flag = lambda n: F.coalesce(F.try_element_at(features, F.lit(PARAMETER_FLAGS.get(n, n))), F.lit(False))
    return supported_parameters({n: flag(n) for n in PARAMETERS})


def defaults_of(generation: Column) -> Column:
    """A map of the parameters' defaults in a map<string,double> of what is generated by default; null if there is none."""
    return default_parameters({n: F.try_element_at(generation, F.lit(PARAMETER_FLAGS.get(n, n) if n != "response_format" else n)) for n in DEFAULTS})


def reasoning_view(reasons: Column, levels: Column, default: Column) -> Column:
    """struct(default_enabled, mandatory, supported_efforts, default_effort) of a model that reasons or has levels, else null."""
    enabled = F.coalesce(reasons, F.lit(False))
    efforts = F.coalesce(F.transform(levels, shown_effort), F.array().cast("array<string>"))
    return F.when(enabled | levels.isNotNull(), F.struct(enabled.alias("default_enabled"), F.lit(False).alias("mandatory"), efforts.alias("supported_efforts"), F.when(levels.isNotNull(), shown_effort(default)).alias("default_effort")))


def operations(inputs: Column, outputs: Column, tags: Column) -> Column:
    """What an offering can be asked to do: embeddings by output or tag, chat for text to text without a special tag."""
    has = lambda c, v: F.coalesce(F.array_contains(c, v), F.lit(False))
    special = F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, SPECIAL_TAGS))), F.lit(False))
    embedding = has(outputs, "embedding") | has(tags, "embedding") | has(tags, "embed")
    chat = has(inputs, "text") & has(outputs, "text") & ~special
    return flag_names({"chat_completions": chat & ~embedding, "embeddings": embedding})


def lifecycle(status: Column) -> Column:
    """The lifecycle of a status: none and ``unknown`` are unknown, ``beta`` counts as preview; a status that isn't in the list raises."""
    return (
        F.when(status.isNull() | status.isin("", "unknown"), "unknown").when(status == "active", "active").when(status.isin("beta", "preview"), "preview")
        .when(status == "deprecated", "deprecated").otherwise(F.raise_error(F.concat(F.lit("unknown status "), status)))
    )


def offering_endpoints(offers: DataFrame, keys: Sequence[str], operation_list: str, endpoints: DataFrame, owner: str, model: str) -> DataFrame:
    """(keys, operation, url): each operation of an offering at its provider's endpoint, the owner's own address first, with the model in its place.

    `endpoints` has (provider_id, operation, base_url, by_owner map<string,string>).
    """
    wanted = offers.select(*keys, owner, model, F.explode(operation_list).alias("operation"))
    joined = wanted.join(endpoints, ["provider_id", "operation"])
    return joined.select(*keys, "operation", F.replace(F.coalesce(F.col("by_owner")[F.col(owner)], F.col("base_url")), F.lit("{model}"), F.col(model)).alias("url"))


def detail(definitions: DataFrame, offers: DataFrame, key: str, best: DataFrame, context: str) -> DataFrame:
    """Definitions with their greatest context over all offerings, their number, and the provider of the best one."""
    sums = offers.groupBy(key).agg(F.coalesce(F.max(context), F.lit(0)).alias("max_context"), F.count(F.lit(1)).alias("offerings"))
    return definitions.join(sums, key, "left").join(best.select(key, F.col("provider_id").alias("top_provider")), key, "left").fillna({"max_context": 0, "offerings": 0})
