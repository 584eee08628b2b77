"""Small document tables with the awkward cases, shared by the operators' tests."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

WORDS = [f"w{i}" for i in range(400)]


def long_text(n=30_000, step=7):
    return " ".join(WORDS[(i * step + i // 11) % 400] for i in range(n))


def awkward():
    base = " ".join(WORDS[:60])
    texts = [
        base, base, base.replace("w30 ", "zz "), None, "", "   \n\t ", "one", "one two three four", long_text(), "Grüße AUS Köln — 漢字 and 😀 smile\u3000wide",
        "a  b \n c\t\td ", "<|endoftext|> in <|endoftext|>text it's we're", " lead and trail ", "x\x1cy \x85 z\xa0q", "İ Σς ΑΣ. Ä é e\u0301",
    ]
    rows = [(i, t, "en", f"s{i % 4}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    rows.append((None, "null key row with words", None, None, None))
    rows.append(rows[1])  # a repeated row
    return rows


def table(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)


def clashing(df):
    """The same rows with extra columns of names that operators use inside."""
    from pyspark.sql import functions as F

    names = "key k t size pattern rid draw cell digest n_tokens version start host path rule verdict cls grams n score row words hits bucket fp part seq".split()
    return df.select("*", *[F.lit("x").alias(n) for n in names if n not in df.columns])
