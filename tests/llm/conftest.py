from __future__ import annotations

import pytest
from pyspark.sql import functions as F

LONG = "palabra " * 3000 + "x" * 30_000 + " fin"
#: Two texts of one doc_id, of several bytes a character and of one, and a third that has the first's passage and more.
SHARED = " ".join(f"é{i}ñ" for i in range(70))
OTHER = " ".join(f"word{i}" for i in range(300))
THIRD = " ".join(f"autre{i}" for i in range(80)) + " " + SHARED


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Null ids and texts, empty and blank texts, very long ones, repeats, two texts of one id, letterless ones, and further columns
    whose names clash."""
    base = [(1, "The quick brown fox jumps over the lazy dog.", "en"), (2, None, "en"), (3, "", None), (4, " \n\t ", "fr"), (5, LONG, "es"), (6, "The quick brown fox jumps over the lazy dog.", "en"), (6, "The quick brown fox jumps over the lazy dog.", "en"), (None, "pas d'identifiant, même texte", "fr"), (8, "日本語のテキスト🙂 <|endoftext|> don't 'll\u00a0x", "ja"), (9, "12345 !!! ???", "en"), (11, SHARED, "fr"), (11, OTHER, "en"), (12, THIRD, "fr"), (13, "½ ² Ⅷ ①", "fr")]
    rows = [(*r, "src", len(r[1] or ""), 1, 2.0, "m", "a", "b", "c", "d", 1, 2) for r in base]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, start long, score double, media string, __cut string, __id string, __kept string, node string, held_out int, slice long")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where(F.lit(False))


@pytest.fixture(scope="session")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def texts_of(docs) -> list[tuple]:
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
