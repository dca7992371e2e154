import pytest


#: Texts that every operator must take: null, empty, blank, one word, repeats, a long run of one character, a long text.
HARD = [None, "", " \t\n ", "word", "word", "a\nb\na\nb", "x" * 50_000, "alpha beta gamma delta " * 3_000, "don't\x0bstop\x0cnow\r\n", "日本語 é́ \U0001f600", "<|endoftext|> a  <|endoftext|>"]


@pytest.fixture
def hard_docs(spark):
    """Hard texts with a null id, repeated rows, and columns whose names operators might use themselves."""
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or ""), "x", 1) for i, t in enumerate(HARD)]
    rows += [rows[3], rows[3], (None, "no id here", None, None, None, None, None), (99, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, n int")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
