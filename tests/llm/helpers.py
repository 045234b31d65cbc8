"""Edge-case rows that all operators must take."""

LONG = "alpha beta gamma delta " * 30_000  # over half a million characters
EXTRA = "k1 string, k2 string, fp string, score double, ids string, w string, pos int, h string, key string, spans string, label string"


def documents(spark, texts, extra=True):
    """documents with ids 0.. and, if asked for, columns named like the operators' own."""
    rows = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    if extra:
        for part in EXTRA.split(", "):
            name, kind = part.split(" ")
            df = df.selectExpr("*", f"cast('7' as {kind}) as {name}")
    return df


def edge(spark, texts=()):
    """The texts, then NULL and empty texts, a very long one, repeated rows and NULL ids."""
    df = documents(spark, [*texts, None, "", LONG, "same row"])
    n = len(texts)
    again = df.where(f"doc_id = {n + 3}")
    nameless = df.where(f"doc_id in ({n}, {n + 3})").selectExpr("cast(null as bigint) as doc_id", *[c for c in df.columns if c != "doc_id"])
    return df.unionByName(again).unionByName(nameless)


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]
