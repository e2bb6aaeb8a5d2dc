import pytest

CLASHES = "keep_id string, fingerprint string, score string, text_sha256 string, Size int"


@pytest.fixture
def documents(spark):
    """Makes a documents table from (doc_id, text) pairs; on request with extra columns whose names the operators use themselves."""

    def make(rows, extra=False):
        ddl = "doc_id long, text string"
        if extra:
            return spark.createDataFrame([(*r, "x", "y", "z", "s", 1) for r in rows], f"{ddl}, {CLASHES}")
        return spark.createDataFrame(list(rows), ddl)

    return make
