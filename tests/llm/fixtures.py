"""Small documents with the awkward cases: nulls, empties, ties, repeats, long texts, clashing columns."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(n=60, seed=3):
    r = random.Random(seed)
    vocab = [a + b for a in ("ba", "te", "lo", "mi", "ru", "só") for b in ("n", "ster", "x", "ya", "k", "ß")]
    passage = " ".join(r.choice(vocab) for _ in range(60))
    base = [" ".join(r.choice(vocab) for _ in range(80)) for _ in range(4)]
    out = []
    for k in range(n):
        own = [r.choice(vocab) for _ in range(r.choice([0, 1, 4, 5, 34, 35, 36, 120]))]
        if k % 5 == 0:
            own = base[k % 4].split()
            own[r.randrange(len(own))] = "edit"
        if k % 7 == 0:
            own[len(own) // 2 : len(own) // 2] = passage.split()
        out.append(r.choice([" ", "\n", "\t \x0b"]).join(own))
    out += [None, "", " \n\t", out[0], out[0], "One", "ONE", "x" * 5000, " ".join(r.choice(vocab) for _ in range(9000)), "password: hunter2hunter2 AKIA" + "Q" * 20 + " " + "0a" * 15, "a<|endoftext|>b  c\n\n d's 12  x"]
    return out


def documents(spark, rows=None):
    rows = list(enumerate(texts())) if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], SCHEMA)


def clashing(df):
    """The same rows with columns named like those that operators make."""
    from pyspark.sql import functions as F

    names = "carry spans ids th sid token n score component_id kept bucket place fingerprint h c key label a b".split()
    return df.select("*", *[F.lit("clash").alias(c) for c in names])


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}
