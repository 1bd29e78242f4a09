"""Small tables with the cases that every operator must stand."""

ODD_TEXTS = [
    None,
    "",
    " \t\n\x0b\x0c\r ",
    "one",
    "Über déjà vu 中文 text",
    "same words here and there again and again",
    "same words here and there again and again",
    "same  words\there\nand there again and again",
    "word " * 3000,
    "A" * 20_000,
    "line one\nline two\n\nline one\r\n",
    "nul \0 inside <|endoftext|> and </s> [INST] \\",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, class_id string"


def odd_documents(spark, texts=None):
    """Odd texts with null, repeated and missing ids and columns that clash with results."""
    texts = ODD_TEXTS if texts is None else texts
    langs, sources = ["en", None, "de"], ["a", None, "b", "a"]
    rows = [
        (None if i == 3 else i, t, langs[i % 3], sources[i % 4], None if i % 2 else len(t or ""), -1, -1.0, "x")
        for i, t in enumerate(texts)
    ]
    rows += [rows[5]] * 2 if len(rows) > 5 else []  # rows that repeat
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]
