"""Column expressions over strings, model answers and references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SHAPE_TYPES = ("ellipse", "circle", "rectangle", "rounded_rectangle", "triangle", "diamond", "polygon", "region", "scribble", "unknown")
REGULAR_TYPES = ("ellipse", "circle", "rectangle", "rounded_rectangle", "triangle", "diamond", "polygon")
RELATION_TYPES = ("contains", "overlaps", "touches", "connected", "near", "labels")
PLACEMENTS = ("inside", "near", "on_line", "free")
DETECTOR_CLASSES = ("ellipse", "circle", "rectangle", "rounded_rectangle", "triangle", "diamond", "polygon", "scribble", "line", "arrow", "text")
TYPE_ALIASES = {
    "oval": "ellipse",
    "cut": "ellipse",
    "square": "rectangle",
    "box": "rectangle",
    "rect": "rectangle",
    "roundrect": "rounded_rectangle",
    "rounded_rect": "rounded_rectangle",
    "rhombus": "diamond",
    "loop": "region",
    "closed_curve": "region",
    "blob": "region",
}
TYPE_FAMILIES = {
    "circle": "round",
    "ellipse": "round",
    "rectangle": "box",
    "rounded_rectangle": "box",
    "triangle": "triangle",
    "diamond": "diamond",
    "polygon": "polygon",
}


def lookup(table: dict, key: Column) -> Column:
    """The value of ``key`` in a small fixed table; null if it is not there."""
    return F.create_map(*(F.lit(v) for pair in table.items() for v in pair))[key]


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def shape_type(c: Column) -> Column:
    """A shape type from a model's word: lower case, blanks and hyphens as underscores, aliases, else unknown."""
    word = F.translate(strip(F.lower(F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown")))), " -", "__")
    word = F.coalesce(lookup(TYPE_ALIASES, word), word)
    return F.when(word.isin(*SHAPE_TYPES), word).otherwise("unknown")


def reference(c: Column) -> Column:
    """An element id from a model's scalar read as a string; false, objects, arrays and blanks give null."""
    word = strip(c)
    return F.when(~word.rlike(r"^[\[{]") & (word != "") & (word != "false"), word)


def truth(c: Column, default: bool | None = False) -> Column:
    """A boolean from a model's scalar read as a string."""
    word = strip(F.lower(c))
    otherwise = F.lit(default).cast("boolean")
    return F.when(word.isin("true", "yes", "y", "1"), F.lit(True)).when(word.isin("false", "no", "n", "0"), F.lit(False)).otherwise(otherwise)


def number(c: Column, low: float, high: float, default: float) -> Column:
    """A parameter from a string, clamped; what is no number gives the default."""
    return F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(c.try_cast("double"), F.lit(default))))


def character_error_rate(reference_text: Column, predicted: Column) -> Column:
    """Edit distance by code points over the reference's length, both stripped; an empty reference gives 0 or 1."""
    a, b = strip(reference_text), strip(predicted)
    return F.when(a == "", F.when(b == "", 0.0).otherwise(1.0)).otherwise(F.levenshtein(a, b) / F.char_length(a))


def same_text(a: Column, b: Column) -> Column:
    return strip(F.lower(a)) == strip(F.lower(b))


def kinds(types: Column) -> Column:
    """``2 circles, 1 rounded rectangle``: counts of an array of types by name, plural over one."""
    names = F.array_sort(F.array_distinct(types))
    each = F.transform(names, lambda k: F.concat(F.size(F.filter(types, lambda t: t == k)).cast("string"), F.lit(" "), F.replace(k, F.lit("_"), F.lit(" ")), F.when(F.size(F.filter(types, lambda t: t == k)) > 1, "s").otherwise("")))
    return F.array_join(each, ", ")


def attached_ids(endpoints: Column) -> Column:
    """Ids that a connector's ends touch: the text's, else the shape's, each once and in order."""
    ids = F.transform(endpoints, lambda e: F.coalesce(F.nullif(e["text_id"], F.lit("")), F.nullif(e["shape_id"], F.lit(""))))
    return F.array_distinct(F.filter(ids, lambda i: i.isNotNull()))


def dot_quoted(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def truncated(c: Column, most: int, mark: str = "...") -> Column:
    return F.when(F.char_length(c) > most, F.concat(F.substring(c, 1, most), F.lit(mark))).otherwise(c)


#: Names that a responder's provider goes by.
PROVIDERS = {
    "anthropic": "anthropic",
    "claude": "anthropic",
    "openai": "openai",
    "gpt": "openai",
    "openai_compatible": "openai_compatible",
    "openai-compatible": "openai_compatible",
    "compat": "openai_compatible",
    "vllm": "openai_compatible",
    "lmstudio": "openai_compatible",
    "llamacpp": "openai_compatible",
    "openrouter": "openai_compatible",
    "gemini": "gemini",
    "google": "gemini",
    "ollama": "ollama",
    "hf": "hf",
    "huggingface": "hf",
    "transformers": "hf",
    "mock": "mock",
}
#: Addresses of providers that run at home, where a specification names none.
ADDRESSES = {
    "ollama": "http://localhost:11434",
    "vllm": "http://localhost:8000/v1",
    "lmstudio": "http://localhost:1234/v1",
    "llamacpp": "http://localhost:8080/v1",
    "openrouter": "https://openrouter.ai/api/v1",
}


def model_spec(spec: Column) -> Column:
    """``provider:model[@url]`` as a struct, the provider by its alias and without an address its own; null if it is none."""
    found = r"^([^:@]+):([^@]+)(?:@(.+))?$"
    name = F.lower(F.regexp_extract(spec, found, 1))
    address = F.coalesce(F.nullif(F.regexp_extract(spec, found, 3), F.lit("")), lookup(ADDRESSES, name))
    provider = lookup(PROVIDERS, name)
    return F.when(spec.rlike(found) & provider.isNotNull(), F.struct(provider.alias("provider"), F.regexp_extract(spec, found, 2).alias("model"), address.alias("base_url")))
