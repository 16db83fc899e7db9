import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def stored(spark, rows, schema, path, parts=3):
    """A stored table, as the operators ask for, with extra columns that have the names operators use."""
    df = spark.createDataFrame(rows, schema).repartition(parts)
    for name in ("row", "key", "n", "score", "size", "keep", "block", "_row", "component"):
        if name not in df.columns:
            df = df.selectExpr("*", f"'x' AS {name}")
    df.write.mode("overwrite").parquet(str(path))
    return spark.read.parquet(str(path))


def edge_rows():
    """Nulls, empty and blank texts, ties, repeated rows, a long text."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    return [
        (1, "one two three four five six seven", "en", "b", 1), (1, "one two three four five six seven", "en", "b", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \t\n", "de", "a", 3),
        (None, "one two three four five six seven", "en", "b", 1), (5, "Über naïve ▁ text \U0001f600 <s> <|endoftext|>", "fr", "é", 5), (6, long, "en", "b", len(long)), (7, "a" * 5000, "en", None, 5000), (8, long + " tail", "en", "a", len(long) + 5),
    ]
