"""Masking and unmasking of personal information, and the whitelist, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import EXEMPT_PATTERNS, EXEMPT_WORDS, PLACEHOLDER, TOKEN_PATTERN
from ..functions.spans import cut, detect, gaps, once, pattern_spans, replace_spans, text_blocks, with_values, without_overlaps
from ..functions.text import token


def full_cover(text: Column, spans: Column, whitelist: Column | None = None, markup: bool = False, placeholder: str = PLACEHOLDER) -> Column:
    """struct(text, chars, used): each span becomes the placeholder. Spans that the markup or the whitelist exempts stay."""
    return replace_spans(text, not_exempt(text, spans, whitelist, markup), lambda x, value: F.lit(placeholder))


def token_mask(text: Column, spans: Column, wrap: bool = False, whitelist: Column | None = None, markup: bool = False) -> Column:
    """struct(text, chars, used): each span becomes its value's token, in brackets if wrap."""

    def surface(x, value):
        t = token(x["label"], value)
        return F.concat(F.lit("["), t, F.lit("]")) if wrap else t

    return replace_spans(text, not_exempt(text, spans, whitelist, markup), surface)


def not_exempt(text: Column, spans: Column, whitelist: Column | None, markup: bool) -> Column:
    if markup:
        spans = once(text_blocks(text), lambda blocks: F.filter(spans, lambda x: ~is_markup(text, x, blocks)))
    if whitelist is not None:
        spans = with_values(text, spans, lambda xs, value: F.filter(xs, lambda x: once(value(x), lambda v: ~whitelisted(v, whitelist))))
    return spans


def is_markup(text: Column, span: Column, blocks: Column | None = None) -> Column:
    """Whether a span is part of the markup: it is one of the words, or within 3 characters of a structure found in the 50
    characters around it, or a short word between ;; and the next colon that contains or is contained in one of the words."""
    blocks = text_blocks(text) if blocks is None else blocks
    begin = F.greatest(span["s"] - 50, F.lit(0))
    parts = F.struct(F.trim(cut(blocks, span["s"], span["e"])).alias("value"), cut(blocks, begin, F.least(F.length(text), span["e"] + 50)).alias("context"))
    return once(parts, lambda p: _is_markup(p["value"], p["context"], span, begin))


def _is_markup(value: Column, context: Column, span: Column, begin: Column) -> Column:
    s, e = span["s"] - begin, span["e"] - begin
    near = F.lit(False)
    for p in EXEMPT_PATTERNS:
        near = near | F.exists(pattern_spans(context, f"(?i){p}", ""), lambda m: (e >= m["s"] - 3) & (s <= m["e"] + 3))
    zone = F.locate(";;", context) - 1
    colon = F.locate(":", context, 1) - 1
    after = F.when(F.locate(";;", context) > 0, F.locate(":", F.substring(context, zone + 1, F.length(context))) + zone - 1)
    words = F.array(*[F.lit(w.lower()) for w in EXEMPT_WORDS])
    related = F.exists(words, lambda w: F.contains(F.lower(value), w) | F.contains(w, F.lower(value)))
    in_zone = (zone >= 0) & (colon >= 0) & (after >= zone) & (zone < s) & (s < after) & (F.length(value) < 20) & ~F.contains(value, F.lit(" ")) & related
    return F.when(value == "", False).otherwise(value.isin(*EXEMPT_WORDS) | near | F.coalesce(in_zone, F.lit(False)))


def whitelist_words(text: Column, spans: Column) -> Column:
    """Distinct words of two letters or digits at least outside all spans, in lower case."""
    words = F.flatten(F.transform(gaps(text, spans), lambda g: F.split(F.lower(g), "[^a-z0-9]+")))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 2))


def whitelisted(value: Column, whitelist: Column, mode: str = "substring") -> Column:
    """substring: any word anywhere in the value exempts it (so 'to' exempts 'Toronto'); word: the whole value must be one."""
    if mode == "word":
        return F.array_contains(whitelist, F.lower(value))
    return F.coalesce(F.exists(whitelist, lambda w: F.contains(F.lower(value), w)), F.lit(False))


def unmask(text: Column, mapping: Column, brackets: bool = True) -> Column:
    """Tokens of mapping (map token -> value) back to values, the longest first; with brackets also where bracketed."""
    entries = F.reverse(F.array_sort(F.transform(F.map_entries(mapping), lambda x: F.struct(F.length(x["key"]).alias("n"), x["key"].alias("k"), x["value"].alias("v")))))

    def step(t, x):
        if brackets:
            t = F.replace(t, F.concat(F.lit("["), x["k"], F.lit("]")), x["v"])
        return F.replace(t, x["k"], x["v"])

    return F.when(mapping.isNull(), text).otherwise(F.aggregate(F.filter(entries, lambda x: x["v"].isNotNull() & (x["k"] != "")), text, step))


def rewrite_action(text: Column, method: Column, mapping: Column) -> Column:
    """An action's text before it is carried out: with tokens put back under the token method (or an unknown one), else as
    it is."""
    return F.when(F.coalesce(method, F.lit("")).isin("", "token_anonymization"), unmask(text, mapping)).otherwise(text)


def unmask_columns(df: DataFrame, columns: list[str], mapping: str) -> DataFrame:
    """df with tokens in its string columns, arrays of strings and maps (keys and values) put back by the map column mapping:
    a tree as node rows, or a step's action with its arguments."""
    kinds, m = dict(df.dtypes), F.col(mapping)

    def restored(c: str) -> Column:
        if kinds[c] == "array<string>":
            return F.transform(c, lambda x: unmask(x, m))
        if kinds[c] == "map<string,string>":
            return F.transform_values(F.transform_keys(c, lambda k, _: unmask(k, m)), lambda _, v: unmask(v, m))
        return unmask(F.col(c), m)

    return df.withColumns({c: restored(c) for c in columns})


def unresolved_tokens(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(1))))


def mapping_of(text: Column, used: Column) -> Column:
    """map token -> value of the spans that a mask used."""
    pairs = with_values(text, used, lambda xs, value: F.transform(xs, lambda x: once(value(x), lambda v: F.struct(token(x["label"], v).alias("k"), v.alias("v")))))
    return F.map_from_entries(F.array_distinct(pairs))


def mask_documents(df: DataFrame, method: str = "token", text: str = "text", markup: bool = False) -> DataFrame:
    """df with spans, masked and masked_chars. Null texts count as empty. method: token or full."""
    found = df.withColumn("spans", detect(F.col(text)))
    value = F.coalesce(F.col(text), F.lit(""))
    result = token_mask(value, F.col("spans"), wrap=markup, markup=markup) if method == "token" else full_cover(value, F.col("spans"), markup=markup)
    # the fold runs only over texts with spans
    done = found.withColumn("_m", F.when(F.size("spans") > 0, result))
    return done.withColumn("masked", F.coalesce("_m.text", value)).withColumn("masked_chars", F.coalesce("_m.chars", F.lit(0)).cast("long")).withColumn("used", F.col("_m.used")).drop("_m")


def registered_first(text: Column, spans: Column, entities: Column) -> Column:
    """Spans of known entities (array of struct(value, label)) found in text, sorted, and detections that overlap none."""
    from ..functions.spans import occurrences

    known = F.flatten(F.transform(entities, lambda x: F.transform(occurrences(text, x["value"]), lambda s: F.struct(s.alias("s"), F.lit(-1).alias("ord"), (s + F.length(x["value"])).cast("int").alias("e"), x["label"].alias("label")))))
    return F.array_sort(F.concat(known, without_overlaps(spans, known)))
