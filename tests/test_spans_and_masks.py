"""Spans, masks and the registry against plain Python models of the rules."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from veilframe.functions import spans as S
from veilframe.functions import text as X
from veilframe.functions.constants import DETECTORS, PLACEHOLDER
from veilframe.operators import mask as M
from veilframe.operators import registry as R

from .models import fold_task

TEXTS = [
    "mail ann@ex.org or +1 415 555 0100",
    "4111 1111 1111 1111",
    "x+4912345678",
    "a" * 495 + " ann@ex.org",
    "😀 ann@ex.org 😀 bob@ex.org",
    "",
    "nothing here",
    "call 555-123-4567, 555-123-4567 or a.b@c.de",
    "1" * 40,
    "٤٥٦٤٥٦٤٥٦٤٥٦ and 12 345 6789",
]


def model_spans(text):
    found = [(m.start(), i, m.end(), label) for i, (label, p) in enumerate(DETECTORS) for m in re.finditer(p, text)]
    return sorted(found)


def greedy(text, spans, surface):
    out, at, n = "", 0, 0
    for s, _, e, label in spans:
        if s >= at and e > s:
            out, at, n = out + text[at:s] + surface(text[s:e], label), e, n + e - s
    return out + text[at:], n


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(4)
    made = ["".join(rng.choice("0123456789 -+@.ab") for _ in range(rng.randint(0, 80))) for _ in range(150)]
    return spark.createDataFrame(list(enumerate(TEXTS + made)), "id long, text string")


def test_spans_equal_the_model(texts):
    for r in texts.select("text", S.detect(F.col("text")).alias("x")).collect():
        assert [tuple(x) for x in r.x] == model_spans(r.text), r.text


def test_masks_equal_the_model(texts):
    rows = M.mask_documents(texts, "full").withColumnRenamed("masked", "full").select("id", "text", "full", "masked_chars")
    tokens = {r.id: r.masked for r in M.mask_documents(texts, "token").collect()}
    for r in rows.collect():
        assert (r.full, r.masked_chars) == greedy(r.text, model_spans(r.text), lambda v, label: PLACEHOLDER)
        assert tokens[r.id] == greedy(r.text, model_spans(r.text), lambda v, label: R.py_token(label, v))[0]


def test_full_cover_is_idempotent_and_masks_no_more_than_there_is(texts):
    once = M.mask_documents(texts, "full")
    assert once.filter("masked_chars > length(text)").count() == 0
    again = M.mask_documents(once.select("id", F.col("masked").alias("text")), "full")
    assert again.filter("masked <> text").count() == 0


def test_unmask_restores(texts):
    rows = M.mask_documents(texts, "token")
    back = rows.select("text", F.when(F.col("used").isNull(), F.col("masked")).otherwise(M.unmask(F.col("masked"), M.mapping_of(F.col("text"), F.col("used")))).alias("b"))
    assert back.filter("b <> text").count() == 0


def test_unmask_takes_longer_tokens_first(spark):
    df = spark.createDataFrame([("[A#1] A#12 A#1", {"A#1": "x", "A#12": "y"}), ("A#1", None)], "t string, m map<string,string>")
    assert [r[0] for r in df.select(M.unmask(F.col("t"), F.col("m"))).collect()] == ["x y x", "A#1"]


def test_hash_equals_python(spark):
    values = ["", "x", "PHONE_NUMBER:555", "é😀"] + [str(i) for i in range(60)]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for r in df.select("v", X.hash5(F.col("v")).alias("h")).collect():
        n, out = int.from_bytes(hashlib.sha256(r.v.encode()).digest(), "big"), ""
        for _ in range(5):
            n, k = divmod(n, 36)
            out = "0123456789abcdefghijklmnopqrstuvwxyz"[k] + out
        assert r.h == out


def test_chunks_cut_what_crosses_them(spark):
    df = spark.createDataFrame([("a" * 495 + " ann@ex.org",), ("x" * 499 + "é",), ("",), (None,)], "text string")
    found = [r[0] for r in df.select(S.detect_chunked(F.col("text"))).collect()]
    assert [(x.s, x.e) for x in found[0]] == [] and found[1:] == [[], [], []]
    whole = df.select(S.detect(F.col("text"))).first()[0]
    assert [(x.s, x.e) for x in whole] == [(496, 506)]


def test_nulls_and_empty_tables(spark):
    empty = spark.createDataFrame([], "id long, text string, spans string")
    assert M.mask_documents(empty, "token").count() == 0
    null = spark.createDataFrame([(1, None)], "id long, text string")
    assert M.mask_documents(null, "full").select("masked", "masked_chars").first() == ("", 0)


def test_whitelist(spark):
    text = "Go to Rome, mail ann@ex.org"
    df = spark.createDataFrame([(text,)], "text string")
    words = df.select(M.whitelist_words(F.col("text"), S.detect(F.col("text")))).first()[0]
    assert words == ["go", "to", "rome", "mail"]
    pick = df.select(*(M.whitelisted(F.lit(v), F.array(*map(F.lit, words)), mode) for v in ("Toronto", "Bonn") for mode in ("substring", "word"))).first()
    assert list(pick) == [True, False, False, False]


def test_markup_exemption(spark):
    df = spark.createDataFrame([("[n12a] View ;click ; ;;call 5551234567: x", 26), ("far away from any markup at all, 5551234567", 33)], "text string, at int")
    got = df.select(M.is_markup(F.col("text"), F.struct(F.col("at").alias("s"), (F.col("at") + 10).alias("e")))).collect()
    assert [r[0] for r in got] == [True, False]


def test_gaps_and_occurrences(spark):
    row = spark.range(1).select(S.occurrences(F.lit("aaaa"), F.lit("aa")), S.occurrences(F.lit("ab"), F.lit("abc")), S.occurrences(F.lit("ab"), F.lit(""))).first()
    assert list(row) == [[0, 1, 2], [], []]


def test_registry_fold_and_first_label(spark):
    rows = [("t", 1, "mail ann@ex.org"), ("t", 2, "again ann@ex.org and xann@ex.orgx"), ("u", 1, "ann@ex.org"), ("u", 2, None)]
    df = spark.createDataFrame(rows, "task string, step int, text string")
    got = {(r.task, r.step): r for r in R.mask_with_registry(df, "task", "step").collect()}
    token = R.py_token("EMAIL_ADDRESS", "ann@ex.org")
    assert got["t", 1].masked == f"mail {token}" and got["t", 2].masked == f"again {token} and x{token}x"
    assert got["u", 2].masked == "" and got["u", 2].masked_chars == 0
    first = R.entities(R.spans_of(df, "task", "step"))
    assert first.filter("task = 't' and value = 'ann@ex.org'").first().token == token
    assert R.collisions(first).count() == 0
    assert {r.masked for r in R.global_mask(df, "task", "step").filter("task = 'u'").collect()} == {token, ""}


def test_prompt_fills_the_whitelist():
    out = list(fold_task(["go to Rome with 5551234567", "Toronto 5551234567 to@ex.org"], prompt_first=True))
    assert out[0][1] and "to@ex.org" in out[1][0] and "5551234567" not in out[1][0]


def test_lookup_reports_missing(spark):
    df = spark.createDataFrame([("t", 1, "mail ann@ex.org")], "task string, step int, text string")
    registry = R.entities(R.spans_of(df, "task", "step"))
    wanted = registry.select("task", "token").union(spark.createDataFrame([("t", "X#00000")], "task string, token string"))
    assert {(r.value, r.missing) for r in R.lookup(registry, wanted).collect()} == {("ann@ex.org", False), (None, True)}


def test_long_texts_with_very_many_spans(spark):
    """Work grows with the spans, not with their square."""
    import time

    n = 32_000
    text = " ".join(f"é{i} mail a{i}@ex.org" for i in range(n))
    df = spark.createDataFrame([(text,)], "text string")
    begun = time.time()
    spans = S.detect(F.col("text"))
    row = df.select(F.size(spans).alias("n"), M.full_cover(F.col("text"), spans)["text"].alias("full"), F.size(S.gaps(F.col("text"), spans)).alias("gaps"), M.token_mask(F.col("text"), spans)["chars"].alias("chars")).first()
    assert row.n == n and row.gaps == n + 1 and row.chars == sum(len(f"a{i}@ex.org") for i in range(n))
    assert row.full == " ".join(f"é{i} mail {PLACEHOLDER}" for i in range(n))
    assert time.time() - begun < 60
