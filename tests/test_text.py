import hashlib
import re

import pytest
from pyspark.sql import functions as F

from pagewright.functions import formats, text
from pagewright.params import CrawlParams, default_stop_words

SAMPLES = [
    "  Ferries, Boats!  That was the LAST one.  ",
    "Été naïve — «quoted» x² 東京 snake_case a b cd",
    "tabs\tand\r\nlines and　spaces\x1cend ",
    "",
    "   \n\t ",
    "don't e-mail 3.14 A_1",
]


def column(spark, fn, values=SAMPLES):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in rows.select("i", fn(F.col("t")).alias("x")).orderBy("i").collect()]


def plain_clean(t):
    return re.sub(r"[^\w\s]", " ", re.sub(r"\s+", " ", t).strip()).lower()


def test_clean_text_follows_the_rule(spark):
    assert column(spark, text.clean_text) == [plain_clean(t) for t in SAMPLES]
    assert column(spark, text.clean_text)[0] == "ferries  boats  that was the last one "


def test_strip_and_lines(spark):
    assert column(spark, text.strip) == [t.strip() for t in SAMPLES]
    expected = [" ".join(x.strip() for x in t.splitlines() if x.strip()) for t in SAMPLES]
    assert column(spark, text.join_lines) == expected


def test_tokens_equal_tokens_of_cleaned_text(spark):
    expected = [re.findall(r"\b\w\w+\b", plain_clean(t)) for t in SAMPLES]
    assert column(spark, text.tokens) == expected


def test_stop_words():
    words = default_stop_words()
    assert len(words) == len(set(words)) == 318
    assert list(words) == sorted(words)


def test_term_counts_and_pairs(spark):
    rows = [(1, ["a", "b", "a", "b"]), (2, ["x"]), (3, [])]
    df = spark.createDataFrame(rows, "id int, words array<string>")
    got = {(r.id, r.term): r.tf for r in text.with_counts(df, text.words_and_pairs("words"), "id").collect()}
    assert got == {(1, "a"): 2, (1, "b"): 2, (1, "a b"): 2, (1, "b a"): 1, (2, "x"): 1}


def test_snippet_and_cache_key(spark):
    assert column(spark, text.snippet, ["a" * 200, "b" * 201]) == ["a" * 200, "b" * 200 + "..."]
    rows = [("  Web Dev ", None), ("web dev", ""), ("WEB DEV", "all"), ("web dev", "x.com")]
    df = spark.createDataFrame(rows, "q string, d string")
    keys = [r.k for r in df.select(text.cache_key("q", "d").alias("k")).collect()]
    assert keys[:3] == [hashlib.md5(b"web dev|all").hexdigest()] * 3
    assert keys[3] == hashlib.md5(b"web dev|x.com").hexdigest()


def test_formats(spark):
    df = spark.sql(
        "SELECT timestamp_ntz'2024-01-01 00:00:07.179575' a, timestamp_ntz'2024-01-01 00:00:07' b"
    )
    row = df.select(
        formats.iso_time("a").alias("a"), formats.iso_time("b").alias("b"),
        formats.score_percent(F.lit(0.70480)).alias("p"), formats.milliseconds(F.lit(12.25)).alias("m"),
        formats.size_mb(F.lit(1572864)).alias("s"), formats.query_label(F.lit("")).alias("q"),
    ).first()
    assert tuple(row) == (
        "2024-01-01T00:00:07.179575", "2024-01-01T00:00:07", "70.5%", "12.3ms", "1.5 MB", "(empty query)",
    )


def test_params_reject_unknown_keys():
    assert CrawlParams.from_mapping({"max_pages": 5}).max_pages == 5
    with pytest.raises(ValueError, match="colour"):
        CrawlParams.from_mapping({"colour": 1})
