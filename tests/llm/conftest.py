import pytest

from ledgermatch.llm.queries import tell_workers


@pytest.fixture(autouse=True)
def workers(spark):
    tell_workers(spark)


DOCS = "doc_id bigint, text string, source string, key string, features int, n bigint"


@pytest.fixture
def docs(spark):
    """A maker of document tables, with columns whose names operators use themselves."""

    def make(rows, partitions=3):
        full = [(i, text, (more or ["s"])[0], "k", 1, 2) for i, text, *more in rows]
        return spark.createDataFrame(full, DOCS).repartition(partitions)

    return make
