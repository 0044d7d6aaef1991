"""Small tables with the cases every operator must stand: nulls, empty and long texts, ties, clashing names."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import functions as F

CLASHING = "block string, ord string, doc string, score string, kept boolean, row string, id string, digest string, spans string"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING
LONG = " ".join(f"word{k % 997} tail{k % 13}." for k in range(30_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from here."),
    (2, None),
    (3, ""),
    (4, " \t\n\r "),
    (5, "###"),
    (6, LONG),
    (7, "The quick brown fox jumps over the lazy dog and runs away from here."),
    (8, "Zażółć gęślą jaźń İstanbul ΣΑΣ 漢字 かな \U0001f600 naïve"),
    (9, "one"),
    (9, "one"),
    (10, "a " * 200),
    (None, "A row without an id, and MIT License text."),
]
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, texts=TEXTS, lang="en"):
    """Documents with extra columns whose names the operators use inside."""
    rows = [(i, t, lang, "src", None if t is None else len(t), *("x",) * 4, True, *("x",) * 4) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def alnum(text):
    return ALNUM.findall((text or "").translate(LOWER))


def held_out(doc_id, divisor):
    return zlib.crc32(str(doc_id).encode()) % divisor == 1


def count(df):
    return df.agg(F.count("*")).first()[0]
