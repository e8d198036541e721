from __future__ import annotations

import pytest
from pyspark.sql import functions as F

TEXTS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


@pytest.fixture
def docs(spark):
    """Documents from (id, text) or (id, text, lang, source)."""

    def make(rows):
        full = [(*r, *("en", "web")[len(r) - 2 :]) if len(r) < 4 else r for r in rows]
        full = [(*r, len(r[1] or "")) for r in full]
        return spark.createDataFrame(full, ", ".join(f"{k} {v}" for k, v in TEXTS.items()))

    return make


@pytest.fixture
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture
def odd():
    """Rows every operator on documents has to survive."""
    return [
        (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "word " * 30_000), (6, "x" * 200_000), (7, "same text here now ok"),
        (8, "same text here now ok"), (8, "same text here now ok"), (None, "no id"), (9, "é 漢字 \U0001f600 a b\x1cc", None, None),
    ]


@pytest.fixture
def clashing():
    """Adds columns whose names the operators use themselves."""

    def add(df):
        for name in ("score", "piece", "node", "pairs", "stratum", "words", "arc", "rank", "block", "fold", "t", "_source", "n", "kept", "_id", "_hash", "h", "bytes", "copies"):
            if name not in df.columns:
                df = df.withColumn(name, F.lit("extra"))
        return df

    return add
