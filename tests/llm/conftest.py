import pytest

from netweave.llm.common import prepare


@pytest.fixture(scope="session", autouse=True)
def ready(spark):
    return prepare(spark)
