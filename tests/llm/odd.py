"""Tables with everything that may be odd in one: nulls, empty and long texts, repeats, and columns named like inner ones."""

LONG = "lorem ipsum dolor sit amet consectetur " * 4_000

ODD = [
    (5, "the quick brown fox jumps over the lazy dog again and again"),
    (5, "the quick brown fox jumps over the lazy dog again and again"),
    (7, None),
    (8, ""),
    (9, " \t\n "),
    (None, "a text that has no id at all but some words in it"),
    (11, "one"),
    (12, "ein Wort"),
    (13, LONG),
    (14, "x" * 50_000),
    (-3, "the quick brown fox jumps over the lazy dog again and AGAIN"),
    (20, "ünïcödé wörds åre ålso wørds 😀 and símbols % $ #"),
    (21, "null\x00byte and <|endoftext|> in a text"),
]


def odd_documents(spark, rows=ODD):
    table = [
        (doc_id, text, "en", "src", 1, "w", 1, "s", 2, "h", 3.0, "k", "v", 4, "f")
        for doc_id, text in rows
    ]
    return spark.createDataFrame(
        table,
        "doc_id long, text string, lang string, source string, n_chars long, _words string, size int, shard string, slot int, "
        "_key string, score double, set_key string, `values` string, rep int, __found string",
    )


def empty_documents(spark):
    return odd_documents(spark, [])
