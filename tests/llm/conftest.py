from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    def docs(rows, extra=""):
        """Documents from (doc_id, text[, source]) with the columns of the table, and a clashing one where asked for."""
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        for name in extra.split():
            df = df.selectExpr("*", f"'x' as {name}")
        return df

    return docs


#: Null, empty, blank, very long, repeated and tied rows.
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "word"), (5, "Straße Ünï 漢字 \U0001f600 x"), (6, "a b c d e f g " * 4000), (7, "word"), (7, "word"), (None, "no id here at all"), (None, None), (8, "x" * 70000)]
