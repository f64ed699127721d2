from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))


@pytest.fixture
def documents(spark):
    """Rows of ``doc_id, text`` as a table like the documents, with columns whose names clash."""

    def make(*rows, extra: str = ""):
        full = [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows]
        df = spark.createDataFrame(full, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG")
        for name in extra.split():
            df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return make
