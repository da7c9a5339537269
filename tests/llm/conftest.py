import pytest
from pyspark.sql import SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark: SparkSession):
    """Documents from texts, or from (doc_id, text[, source]) tuples; columns beyond the usual can clash with internal names."""

    def build(rows, **extra):
        full = []
        for i, r in enumerate(rows):
            r = (i, r) if not isinstance(r, tuple) else r
            full.append((r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), *extra.values()))
        return spark.createDataFrame(full, DOCS + "".join(f", {c} string" for c in extra))

    return build


#: Names that operators use inside; a user's column of such a name must not disturb them.
CLASHES = {"digest": "x", "node": "x", "size": "x", "copies": "x", "shard": "x", "part": "x", "keep_id": "x", "kept_id": "x", "bucket": "x", "score": "x", "salt": "x", "doc": "x", "again": "x", "mix_id": "x", "size_": "x", "label": "x"}
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "same text here for all"), (6, "same text here for all"), (6, "same text here for all"), (None, "no id at all here"), (7, "word " * 30_000), (8, "Ünï çödé — 漢字 \U0001f600 text")]
