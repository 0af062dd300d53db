"""Documents that operators must take: nulls, empty and very long texts, ties, repeated rows, and columns with clashing names."""

import random

from pyspark.sql import functions as F

CLASHES = ("id", "row", "unit", "bucket", "band", "key", "slot", "shard", "host", "place", "copy", "ids", "n_ngrams", "kept", "start", "size", "value", "n", "quality")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    syllables = ("ba", "ke", "li", "mo", "nu", "ra", "si", "to", "vé", "zü")
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 5))) for _ in range(n))


def documents():
    rng = random.Random(5)
    base = words(rng, 60)
    passage = words(rng, 40)
    lines = "\n".join(words(rng, 8) for _ in range(12))
    secret = "password = abcdef123456 and AKIA" + "Q7" * 9 + " or token=abc, " + "0123456789abcdef" * 2
    rows = [
        (1, base, "en", "a"),
        (2, None, "en", "a"),
        (3, "", "en", "b"),
        (4, "   \n\t ", None, None),
        (5, base, "en", "b"),
        (6, base.replace("ba", "ke", 1), "en", "c"),
        (7, words(rng, 30) + " " + passage + " " + words(rng, 30), "fr", "c"),
        (8, words(rng, 20) + " " + passage + " " + words(rng, 20), "fr", "a"),
        (9, words(rng, 20_000), "de", "a"),
        (10, "ab" * 40_000, "en", "d"),
        (11, lines, "en", "a"),
        (12, "intro line\n" + lines + "\noutro line", "en", "b"),
        (12, "intro line\n" + lines + "\noutro line", "en", "b"),
        (13, secret, "en", "a"),
        (14, "x" + secret, "en", "b"),
        (15, "SECRET: 'zz/zz+zz==' " + secret, "fr", "c"),
        (16, "word", "en", "a"),
        (17, "word", "en", "a"),
        (18, "naïve 漢字 😀 \u2003\x01\x01\x02 end\x00", "en", "e"),
        (None, base, "en", "a"),
        (None, None, None, None),
        (-3, words(rng, 3), "en", "a"),
    ]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


def frame(spark, rows=None, clashes=True):
    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in CLASHES}) if clashes else df


def write(spark, folder, docs, **tables):
    docs.write.parquet(f"{folder}/documents.parquet")
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
