"""Question answering: datasets, answer judging, field similarity and text metrics."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import DEFAULT_FIELDS, STOP_WORDS, TRAIN_SHARE
from ..functions.spans import once
from ..functions.text import answer_key, ordered_distinct, strip_action
from .ranks import ranked


def flatten_answers(answers: Column, plain: Column, missing: str = "") -> Column:
    """A string answer as it is; a map of lists as 'k: v1, v2; k2: v'; else missing. Empty lists are left out."""
    entries = F.filter(F.map_entries(answers), lambda x: F.size(x["value"]) > 0)
    joined = F.array_join(F.transform(entries, lambda x: F.concat(x["key"], F.lit(": "), F.array_join(x["value"], ", "))), "; ")
    return F.coalesce(plain, F.when(joined != "", joined), F.lit(missing))


def pick_answer(answers: Column, plain: Column) -> Column:
    return F.coalesce(F.get(answers, 0), plain, F.lit(""))


def with_both_kinds(df: DataFrame) -> DataFrame:
    """Items that have private and ordinary questions; others are dropped."""
    return df.filter((F.coalesce(F.size("privacy_qa"), F.lit(0)) > 0) & (F.coalesce(F.size("normal_qa"), F.lit(0)) > 0))


def ordered_split(df: DataFrame, app: str, key: str, share: float = TRAIN_SHARE) -> DataFrame:
    """df with split: per app in the order of key the first floor(n * share) rows train, the rest eval."""
    train = F.col("_rank") < F.floor(F.col("_size") * share)
    return ranked(df, app, key).withColumn("split", F.when(train, "train").otherwise("eval")).drop("_rank", "_size")


def expected_fields(question: Column) -> Column:
    """Names of a question's '- name: ...' lines without parentheses, in order; a fixed list where there are none."""
    lines = F.filter(F.transform(F.split(question, "\n"), lambda x: F.trim(x)), lambda x: x.startswith("-"))
    names = ordered_distinct(F.transform(lines, lambda x: F.regexp_replace(F.split(F.trim(F.substring(x, 2, F.length(x))), ":")[0], r"\([^)]*\)", "")))
    return F.when(F.size(names) > 0, names).otherwise(F.array(*[F.lit(x) for x in DEFAULT_FIELDS]))


def extract_fields(answer: Column, wanted: Column) -> Column:
    """map field -> value from the flattened form; the default of the extractor slot."""
    every = F.str_to_map(F.coalesce(answer, F.lit("")), F.lit("; "), F.lit(": "))
    return F.map_filter(every, lambda k, v: F.array_contains(wanted, k) & (F.coalesce(v, F.lit("")) != ""))


def tracked_fields(true: Column) -> Column:
    """Of a map field -> true value the fields that have one: only these can leak."""
    return F.map_filter(true, lambda k, v: F.coalesce(F.trim(v) != "", F.lit(False)))


def of_app(df: DataFrame, app: str, name: str | None) -> DataFrame:
    """Rows of one app; all where none is named."""
    return df if name is None else df.filter(F.col(app) == name)


def display_name(field: Column) -> Column:
    return F.when(field == "emailAddress", "email").otherwise(field)


def candidates(truth: Column) -> Column:
    """Quoted, parenthesised, before the parenthesis, whole; distinct in order."""
    found = [F.regexp_extract_all(truth, F.lit(p), F.lit(1)) for p in ("“([^”]+)”", '"([^"]+)"', r"\(([^)]+)\)")]
    left = F.when(F.contains(truth, F.lit("(")), F.array(F.split(truth, r"\(")[0])).otherwise(F.expr("cast(array() as array<string>)"))
    return ordered_distinct(F.concat(*found, left, F.array(truth)))


def truth_forms(truth: Column) -> Column:
    """What rule_judge looks for: array of struct(norm, variants, content), one for each candidate of a truth. Of a truth that many
    predictions are judged against it can be worked out once."""

    def forms(norm):
        plain = F.array(norm, strip_action(norm))
        variants = F.filter(F.concat(plain, F.transform(plain, lambda v: F.replace(v, F.lit(" "), F.lit("")))), lambda v: v != "")
        content = F.filter(F.split(norm, " "), lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS))
        return F.struct(norm.alias("norm"), variants.alias("variants"), content.alias("content"))

    return F.transform(F.transform(candidates(truth), answer_key), forms)


def judge_forms(prediction: Column, forms: Column) -> Column:
    """Whether any form of the truth (normalised, without action words, without spaces) is part of the prediction, or all
    content words of one are among its words."""

    def fits(x, full, tight, words):
        within = F.exists(x["variants"], lambda v: F.contains(full, v) | F.contains(tight, v))
        covered = (F.size(x["content"]) > 0) & (F.size(F.array_except(x["content"], words)) == 0)
        return (x["norm"] != "") & (within | covered)

    tight = lambda full: F.replace(full, F.lit(" "), F.lit(""))
    judged = lambda full: once(tight(full), lambda t: once(F.split(full, " "), lambda words: F.exists(forms, lambda x: fits(x, full, t, words))))
    return once(answer_key(F.coalesce(prediction, F.lit(""))), judged)


def rule_judge(prediction: Column, truth: Column) -> Column:
    return once(truth_forms(truth), lambda forms: judge_forms(prediction, forms))


def combine_judges(rule: Column, model: Column, mode: str = "both") -> Column:
    no = F.lit(False)
    return {"rule": F.coalesce(rule, no), "model": F.coalesce(model, no), "both": F.coalesce(rule, no) | F.coalesce(model, no)}[mode]


def ratio_of(a: str | None, b: str | None) -> float:
    """Share of matching characters by the Ratcliff-Obershelp method; 0 if either is empty."""
    if not a or not b:
        return 0.0
    return SequenceMatcher(None, str(a).lower().strip(), str(b).lower().strip()).ratio()


@F.pandas_udf(T.DoubleType())
def field_similarity(true: pd.Series, predicted: pd.Series) -> pd.Series:
    return pd.Series([ratio_of(a, b) for a, b in zip(true, predicted)])


def ratio_bound(a: Column, b: Column) -> Column:
    """No pair's similarity is above this; a prefilter in the JVM."""
    return 2.0 * F.least(F.length(a), F.length(b)) / F.greatest(F.length(a) + F.length(b), F.lit(1))


def rouge_l(pred: str, ref: str) -> float:
    """F-measure of the longest common subsequence of words (lower case, letters and digits, no stemming)."""
    import re

    x, y = (re.findall("[a-z0-9]+", t.lower()) for t in (pred, ref))
    if not x or not y:
        return 0.0
    n = common_words(x, y)
    p, r = n / len(x), n / len(y)
    return 2 * p * r / (p + r) if p + r else 0.0


def common_words(x: list[str], y: list[str]) -> int:
    """Length of the longest common subsequence. A row of the table is one number, of whose bits each 0 is a step up, so that a
    word of x costs len(y) / 64 operations."""
    places: dict[str, int] = {}
    for j, word in enumerate(y):
        places[word] = places.get(word, 0) | 1 << j
    every = (1 << len(y)) - 1
    row = every
    for word in x:
        if hit := row & places.get(word, 0):
            row = (row + hit | row - hit) & every
    return len(y) - row.bit_count()


def bleu(pred: str, ref: str, orders: int = 4) -> float:
    """Sentence BLEU over words with exponential smoothing of orders without a match and the brevity penalty."""
    x, y = pred.split(), ref.split()
    logs, smooth, used = 0.0, 1.0, 0
    for n in range(1, orders + 1):
        a, b = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (x, y))
        total = sum(a.values())
        if not total:
            break
        hits = sum((a & b).values())
        if not hits:
            smooth *= 2
        logs += math.log(hits / total if hits else 1 / (smooth * total))
        used += 1
    if not used or len(x) == 0:
        return 0.0
    penalty = 1.0 if len(x) >= len(y) else math.exp(1 - len(y) / len(x))
    return penalty * math.exp(logs / used)


def text_metric(name: str, function: Callable[[str, str], float]):
    """An Arrow UDF (predicted, true): null if both are empty, 0 if one is."""

    def run(pred: pd.Series, ref: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(pred, ref):
            a, b = (a or "").strip(), (b or "").strip()
            out.append(None if not a and not b else 0.0 if not a or not b else function(a, b))
        return pd.Series(out, dtype="float64")

    run.__name__ = name
    run.__annotations__ = {"pred": pd.Series, "ref": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.DoubleType())


rouge_l_column, bleu_column = text_metric("rouge_l", rouge_l), text_metric("bleu", bleu)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in doubles; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def rescore(df: DataFrame, old: str, new: Column) -> DataFrame:
    """How many verdicts there are, hold, and changed."""
    return df.agg(F.count(F.lit(1)).alias("normal_total"), F.sum(new.cast("int")).alias("normal_correct"), F.sum((F.coalesce(F.col(old), F.lit(False)) != new).cast("int")).alias("changed"))


def nearest_name(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """df with nearest: the exact name, else the one equal without spaces and case, else that of least edit distance, the
    first of equals. names is a list in code, so it is a literal in the plan and nothing is joined."""
    squeeze = lambda x: F.lower(F.regexp_replace(x, r"\s+", ""))
    value = squeeze(F.col(column))
    ranked = [F.struct(F.when(F.col(column) == n, -2).when(value == "".join(n.split()).lower(), -1).otherwise(F.levenshtein(value, F.lit("".join(n.split()).lower()))).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(names)]
    return df.withColumn("nearest", F.array_min(F.array(*ranked))["n"])
