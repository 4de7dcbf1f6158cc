from __future__ import annotations

import pytest

EXTRA = "size int, score string, node double, row string, key int, hash int, batch int, threshold int, place int, k int, n int, lines int, block int, first int, host int, trust int, `x.y` int, `a``b` int"


def widened(spark, rows, schema):
    """Rows with extra columns whose names operators use themselves."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    extra = [c for c in EXTRA.split(", ") if c.split(" ")[0].strip("`") not in names]
    fill = {"int": 7, "string": "x", "double": 0.5}
    return spark.createDataFrame([(*r, *(fill[c.split(" ")[1]] for c in extra)) for r in rows], schema + ", " + ", ".join(extra))


@pytest.fixture
def wide(spark):
    return lambda rows, schema: widened(spark, rows, schema)


@pytest.fixture
def documents(wide):
    """A table of documents, with clashing extra columns, from (doc_id, text) or (doc_id, text, source)."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        return wide(full, "doc_id long, text string, lang string, source string, n_chars long")

    return make
