"""Scalar functions, redaction and receipts on literal inputs and against plain-Python rules."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from obsframe.functions import paths as px
from obsframe.functions import receipts as rc
from obsframe.functions import text as fx
from obsframe.functions.redaction import redact
from obsframe.params import Params

REPLACEMENT = "�"
SAMPLES = ["", "plain ascii text", "héllo wörld", "日本語テキスト", "a😀b😀c", "é😀é日x", "\n\n"]


def decoded(raw: bytes) -> str:
    return raw.decode("utf-8", errors="replace")


def sliced(text: str, offset: int, limit: int) -> str:
    """The decoded slice may not be longer than the limit: drop bytes from its end until it is not."""
    raw = text.encode()
    end = min(len(raw), offset + limit)
    out = decoded(raw[offset:end])
    while end > offset and len(out.encode()) > limit:
        end -= 1
        out = decoded(raw[offset:end])
    return out


def test_byte_slice(spark):
    cases = [(t, o, n) for t in SAMPLES for o in range(0, len(t.encode()) + 1) for n in range(1, 14)]
    df = spark.createDataFrame(cases, "t string, o int, n int")
    got = df.select("t", "o", "n", fx.byte_slice("t", F.col("o"), F.col("n")).alias("s")).collect()
    wrong = [(r.t, r.o, r.n, r.s, sliced(r.t, r.o, r.n)) for r in got if r.s != sliced(r.t, r.o, r.n)]
    assert not wrong, wrong[:5]


def test_clip(spark):
    cases = [(t, n) for t in SAMPLES for n in range(1, 20)]
    df = spark.createDataFrame(cases, "t string, n int")
    got = df.select("t", "n", fx.clip_bytes("t", F.col("n")).alias("c"), fx.prefix_bytes("t", F.col("n")).alias("p")).collect()
    for r in got:
        whole = r.t if len(r.t.encode()) <= r.n else sliced(r.t, 0, r.n)
        assert r.c == whole
        assert r.p == r.t.encode()[: r.n].decode(errors="ignore")


def test_ids_and_messages(spark):
    row = spark.range(1).select(
        fx.observation_id(F.lit("session"), F.lit("call-0")).alias("o"),
        fx.project_id(F.lit("/work/tree")).alias("p"),
        fx.bounded_message(F.lit(" a \n\t b   c" + "x" * 600)).alias("m"),
        fx.tool_label(F.lit("naïve😀tool" + "t" * 80)).alias("l"),
        fx.token_estimate(F.lit(10)).alias("k"),
    ).first()
    assert row.o.startswith("obs_") and len(row.o) == 28 and len(row.p) == 32
    assert row.m.startswith(" a b c") and len(row.m) == 512
    assert row.l.startswith("na?ve??tool") and len(row.l) == 64
    assert row.k == 4


def test_lexical_terms(spark):
    row = spark.range(1).select(
        fx.lexical_terms(F.lit("src/Main-File.ts"), F.lit("Größe $x a _id Größe main-file")).alias("t")
    ).first()
    assert row.t == ["src", "main-file", "ts", "größe", "$x", "_id"]


SECRETS = "\n".join(
    [
        "API_KEY=abc123def",
        "export AWS_SECRET_ACCESS_KEY=zzz999",
        "service_auth_token: qqq888",
        "Authorization: Bearer aaa.bbb.ccc",
        "\"db-password\" = 'p w'",
        "status=healthy",
        "-----BEGIN RSA PRIVATE KEY-----\nMIIB\nxyz\n-----END RSA PRIVATE KEY-----",
        "seen ghp_ABCDEFGHIJKLMNOPQRSTUVWX here",
        "postgres://user:hunter2@db/prod",
    ]
)


def test_redaction_rules(spark):
    df = redact(spark.createDataFrame([(SECRETS,)], "text string"))
    row = df.first()
    assert row.redactions == 8
    for secret in ("abc123def", "zzz999", "qqq888", "aaa.bbb", "p w", "MIIB", "ghp_", "hunter2"):
        assert secret not in row.sanitized
    assert "status=healthy" in row.sanitized
    assert "\"db-password\" = '[REDACTED]'" in row.sanitized
    assert "-----BEGIN RSA PRIVATE KEY-----\n[REDACTED]\n-----END RSA PRIVATE KEY-----" in row.sanitized
    again = redact(df.select(F.col("sanitized").alias("text"))).first()
    assert again.sanitized == row.sanitized


def test_redaction_leaves_plain_text(spark):
    text = "the monkey has a token of love, and http://example.com/a:b is open"
    row = redact(spark.createDataFrame([(text,)], "text string")).first()
    assert (row.sanitized, row.redactions) == (text, 0)


def receipt_rows(spark, contents, limit):
    df = spark.createDataFrame([(c,) for c in contents], "sanitized string").select(
        F.lit("obs_" + "0" * 24).alias("observation_id"),
        F.sha2("sanitized", 256).alias("artifact_id"),
        F.lit("bash").alias("tool_name"),
        F.lit(10_000).cast("long").alias("original_bytes"),
        F.octet_length("sanitized").cast("long").alias("sanitized_bytes"),
        F.lit(3).cast("long").alias("redactions"),
        F.lit(True).alias("is_error"),
        "sanitized",
    )
    return rc.receipt(df, limit).select("sanitized", "receipt", rc.is_receipt("receipt").alias("ok")).collect()


def test_receipt_is_the_longest_that_fits(spark):
    rng = random.Random(3)
    alphabet = 'ab"\\\n\t\x01éß日😀'
    contents = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 700))) for _ in range(60)]
    for r in receipt_rows(spark, contents, 640):
        assert r.ok and len(r.receipt.encode()) <= 640
        value = json.loads(r.receipt)
        preview = value["evidence"]["preview"]
        assert r.sanitized.startswith(preview)
        if preview != r.sanitized:
            value["evidence"]["preview"] = r.sanitized[: len(preview) + 1]
            longer = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
            assert len(longer.encode()) > 640


def test_receipt_bounds(spark):
    with pytest.raises(ValueError):
        receipt_rows(spark, ["x"], 511)
    rows = receipt_rows(spark, ["short", "y" * 5000], 512)
    assert all(len(r.receipt.encode()) <= 512 for r in rows)


@pytest.mark.parametrize(
    "text,expected",
    [('{"type":"observation_receipt"}', True), ('{"type":"x"}', False), ("plain", False), ("[1]", False), ('{"a":', False)],
)
def test_receipt_detection(spark, text, expected):
    assert spark.range(1).select(rc.is_receipt(F.lit(text))).first()[0] is expected


def test_paths(spark):
    rows = [("a/b/.java",), ("a/B.Java",), ("x.tar.gz",), ("dir.ts/file",), ("/abs",), ("a/../b",), ("",), ("w\\z.mts",)]
    got = spark.createDataFrame(rows, "path string").select(
        px.extname(px.normalize_path("path")).alias("e"), px.language(px.normalize_path("path")).alias("l"), px.is_safe_path("path").alias("s")
    ).collect()
    assert [(r.e, r.l, r.s) for r in got] == [
        ("", "text", True), (".java", "java", True), (".gz", "text", True), ("", "text", True),
        ("", "text", False), ("", "text", False), ("", "text", False), (".mts", "typescript", True),
    ]


def test_params():
    assert Params().receipt_max_bytes == 4096
    assert Params.from_mapping({"map_exclude_patterns": ["a/**"]}).map_exclude_patterns == ("a/**",)
    for bad in (
        {"retention_days": -1}, {"receipt_max_bytes": 511}, {"hot_observation_count": 1.5}, {"no_such": 1},
        {"soft_context_ratio": 0.5, "target_context_ratio": 0.5}, {"soft_context_ratio": 1.0},
        {"map_exclude_patterns": [" "]}, {"map_injection_mode": "sometimes"}, {"map_context_max_bytes": 100},
        {"map_quota_bytes": 0}, {"hot_observation_count": True},
    ):
        with pytest.raises(ValueError):
            Params.from_mapping(bad)
