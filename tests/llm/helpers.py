"""Small tables with the awkward rows that every operator has to take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def doc(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text))


def documents(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def awkward(spark):
    """Nulls in every column, empty and blank texts, repeated rows, a long text, non-ASCII, ties."""
    long_text = "word " * 30_000 + "end"
    rows = [
        doc(1, "the quick brown fox jumps over the lazy dog"), doc(1, "the quick brown fox jumps over the lazy dog"),
        doc(2, "the quick brown fox jumps over the lazy dog"), doc(3, None), doc(3, None), doc(4, ""), doc(5, " \n\t "),
        doc(None, "nobody owns this text", None, None), doc(None, "nobody owns this text", None, None), (None, None, None, None, None),
        doc(6, long_text), doc(7, "Ünïcödé 日本語 \U0001F600 ½ $$$ 12345"), doc(8, "123 456 !!"), doc(9, "a"),
    ]
    return documents(spark, rows)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
