import random

import pytest
from pyspark.sql import types as T

FIELDS = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()),
          ("n_chars", T.LongType()), ("node", T.StringType()), ("label", T.StringType()), ("_row", T.LongType())]


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text, lang, source) as a table with further columns whose names clash with inner ones."""
    def build(rows):
        schema = T.StructType([T.StructField(n, t) for n, t in FIELDS])
        full = [(i, t, lang, s, None if t is None else len(t), "x", None, 1) for i, t, lang, s in rows]
        return spark.createDataFrame(full, schema)
    return build


@pytest.fixture(scope="session")
def prose():
    """Invented sentences of a few vocabularies, the same at every run."""
    rnd = random.Random(5)
    kinds = {"aa": "the of and that ing tion er on with", "bb": "der die und sch keit ung ein von", "cc": "que los ción por una del es"}

    def make(kind: str, n: int) -> str:
        parts = kinds[kind].split()
        words = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 3))) for _ in range(n)]
        return " ".join(words)
    return make


#: Texts that every operator must take.
ODD = [None, "", " ", "\n\n", "a", "ü", "\x0b\x0c", "   two  words ", "1234 5678", "漢字かな 😀 text", "x" * 5000,
       "word " * 3000, "same line\nsame line\nsame line", "tab\tand\r\nreturn", "▁ ▁▁", "#*$%&|<> !!", "½ ² 12 ⅷ"]
