"""Small tables that hold the awkward cases every operator must take."""

import random
import re

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n, letters="abcdefghijkl"):
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))) for _ in range(n)]


def documents(spark, seed=7, n=60):
    """Random texts with copies, near copies, shared passages, nulls, empty and very long ones and repeated rows."""
    rng = random.Random(seed)
    passage = words(rng, 60)
    rows = []
    for k in range(n):
        text = words(rng, rng.randrange(0, 60))
        if k % 3 == 0:
            start = rng.randrange(40)
            text[len(text) // 2:len(text) // 2] = passage[start:start + rng.randrange(5, 40)]
        if k % 7 == 0:
            text += ["z"] * 45
        rows.append([k, "  ".join(text) if k % 5 else " ".join(text), "en" if k % 2 else None, f"src{k % 4}", len(text)])
    rows[10][1] = rows[4][1]
    rows[11][1] = rows[4][1] + " tail"
    rows[12][1] = None
    rows[13][1] = ""
    rows[14][1] = " \n\t"
    rows[15][1] = "É " * 3 + "漢字 😀 ÀB Zz"
    rows[16][1] = " ".join(words(rng, 60_000))
    rows += [list(rows[4]), list(rows[12]), [None, rows[5][1], None, None, None], [None, None, None, None, None]]
    return spark.createDataFrame([tuple(r) for r in rows], DOCS)


def with_clashing_columns(df):
    """The same rows with columns named like those the operators make for themselves."""
    from pyspark.sql import functions as F

    extra = ["fp", "rank", "curve", "id", "c1", "told", "anchor", "anchors", "key", "host", "path", "listed", "part", "block", "at", "n",
             "score", "held_out", "tail_probability", "expected_grade", "root", "node", "size", "shard", "first_id", "bucket", "level"]
    return df.select("*", *[F.lit("clash").alias(c) for c in extra if c not in df.columns])


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
