import zlib

import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows):
        """A documents table with clashing extra columns from (doc_id, text) rows."""
        names = ["doc_id", "text", "kept", "component_id", "n_tokens", "score", "packed", "digest", "media", "sequence_id"]
        schema = "doc_id long, text string, " + ", ".join(f"{n} string" for n in names[2:])
        return spark.createDataFrame([(i, t, *("x" for _ in names[2:])) for i, t in rows], schema)

    return make


@pytest.fixture(scope="session")
def held_out():
    return lambda i: zlib.crc32(str(i).encode()) % 5 == 0
