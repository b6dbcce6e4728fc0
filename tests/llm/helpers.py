import random

DOCS = "doc_id long, text string, lang string, source string"


def texts(n=120, seed=3):
    """Rows with copies, near copies, empty, null and long texts, ties, and a source that is null."""
    r = random.Random(seed)
    words = ["the", "of", "And", "thing", "été", "ñandú", "sch", "tion", "x1", "a.b", "Äö,", "…", "don't"]
    rows = []
    for k in range(n):
        t = " ".join(r.choice(words) + (r.choice("abc") if r.random() < 0.3 else "") for _ in range(r.randint(1, 60)))
        if k % 7 == 0 and rows:
            t = rows[-1][1]
        if k % 11 == 0 and rows and rows[-2 if len(rows) > 1 else -1][1]:
            t = rows[-1][1].upper() if rows[-1][1] and rows[-1][1].isascii() else rows[-1][1]
        if k % 13 == 5:
            t = (t + "\n\n ") * 3
        rows.append((k, t, r.choice(["en", "fr", None]), r.choice(["a", "b", "b", "b", None, "é"])))
    rows += [(n, None, None, None), (n + 1, "", "en", "a"), (n + 2, " \t\n", "en", "a"), (n + 3, "word " * 5000, "en", "b"), (None, "no id", "en", "b"), (5, rows[5][1], rows[5][2], rows[5][3])]
    return rows


def frame(spark, rows, clash=True):
    """The rows as a table with extra columns whose names operators use inside."""
    df = spark.createDataFrame(rows, DOCS)
    if clash:
        from pyspark.sql import functions as F

        for name in ("id", "norm", "digest", "size", "fp", "p", "block", "length", "n_chars"):
            df = df.withColumn(name, F.lit(1))
    return df
