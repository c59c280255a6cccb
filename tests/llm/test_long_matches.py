"""Texts with very many matches, and places against Python's own search."""

import re
import time

from pyspark.sql import functions as F

from riskloom.llm import pii

IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")


def test_places_of_matches(spark):
    texts = [("é" * (i % 3) + " 1.2.3.4 x😀" * n + "5.6.7.8" * (i % 2)) for i, n in enumerate((0, 1, 2, 255, 256, 257, 513))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: [(m.s, m.e, m.v) for m in r.m] for r in df.select("i", F.expr(pii._placed(rf"r'{pii.PATTERNS['ip']}'")).alias("m")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == [(m.start(), m.end(), m[0]) for m in IP.finditer(t)]


def test_a_hundred_thousand_matches(spark):
    text = "".join(f"10.{i % 250}.{i // 250 % 250}.{i % 7} host{i % 5} " for i in range(100_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.monotonic()
    assert pii.find_personal_data(df, min_contexts=10**9).select(F.size("base").alias("n")).first().n == 100_000
    assert time.monotonic() - began < 90


def test_cut_is_substring(spark):
    text = "aé😀z" * 850
    pieces = f"regexp_extract_all(t, r'(?s).{{1,{pii._PIECE}}}', 0)"
    asked = [(text, start, size) for start in (1, 2, 999, 1000, 1001, 1999, 2000, 2001, 3399, 3400, 3401) for size in (0, 1, 100, 1000)]
    df = spark.createDataFrame([*asked, ("", 1, 5)], "t string, a int, n int").select("t", "a", "n", F.expr(pii._let("c", pieces, pii._cut("a", "n"))).alias("x"))
    for r in df.collect():
        assert r.x == r.t[r.a - 1 : r.a - 1 + r.n]
