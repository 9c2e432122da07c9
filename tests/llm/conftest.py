import pytest

KEYED = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """``documents`` from (doc_id, text[, source[, lang]]), with columns of clashing names besides."""

    def make(rows, extra=True):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, KEYED)
        if extra:
            for name in ("key", "n", "row", "place", "size", "rid", "cid", "root", "label", "block", "word", "times", "kept"):
                df = df.withColumn(name, df["n_chars"])
        return df

    return make
