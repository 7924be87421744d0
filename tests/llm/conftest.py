import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, _text string, `odd name` int"


@pytest.fixture(scope="session")
def odd_texts():
    """Texts that are easily treated wrongly."""
    prose = "Ertion on the it is onenerth edonre ontiatth edes erat as on oransh of shat erre rely. "
    return [None, "", " \t\r\n ", "one", "one two three", "The same text. " * 20, "The same text. " * 20, prose, prose.upper(), prose.replace(" ", "  "),
            "word " * 30_000, "x" * 70_000, "naïve ÀÉ Éİ ΣΑΣ 日本 語　", "Don't <|endoftext|>x<|ENDOFTEXT|> y", "a\x01b \x01 c", "a\x0bb\x0cc\x85d\xa0e f​g",
            " ́x", "　 　", "'s 123 !!,, 's", "line\nline\n\nline\n", "".join(chr(c) for c in range(1, 128))]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """The odd texts with null and repeated ids, repeated rows, null columns, and columns that operators use inside."""
    rows = [(k, x, None if k % 3 == 0 else "en", "s" if k % 2 else None, None, None, "other", k) for k, x in enumerate(odd_texts)]
    rows += [rows[7], rows[7], (7, "another text under the same id", "en", "s", 1, True, None, 1), (None, "a text without an id", None, None, None, None, None, None),
             (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
