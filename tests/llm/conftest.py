from collections.abc import Callable

import pytest
from pyspark.sql import DataFrame

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, words string, key string"


@pytest.fixture(scope="session")
def make(spark) -> Callable[..., DataFrame]:
    """Documents with columns whose names operators use themselves."""

    def build(texts, ids=None, sources=None):
        ids = ids if ids is not None else range(len(texts))
        sources = sources if sources is not None else ["a"] * len(texts)
        rows = [(i, t, None, s, None if t is None else len(t), 7, "w", "k") for i, t, s in zip(ids, texts, sources, strict=True)]
        return spark.createDataFrame(rows, SCHEMA)

    return build


ODD = [
    None, "", " \n\t", "one", "Two words", "the cat sat on the mat and then the cat sat on the mat again " * 3,
    "the cat sat on the mat and then the cat sat on the mat again " * 3, "x" * 5000, "a b\n" * 4000,
    "İstanbul ÀB don't <|endoftext|> 12,5 ... x y", "  wide　 spaces    and \x1c more"]
