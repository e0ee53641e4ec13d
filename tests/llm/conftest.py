import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """(doc_id, text) pairs as documents with further columns whose names the
    operators use inside."""
    def documents(pairs):
        d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in pairs], DOCS).repartition(3)
        return d.withColumns({c: F.lit(7) for c in ("key", "fp", "mark", "y", "cls", "pos", "kept", "score", "component", "bucket")})
    return documents


def rowset(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)
