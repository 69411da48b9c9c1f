import pytest


@pytest.fixture(scope="session", autouse=True)
def tidy(spark):
    from siltstone.llm.common import clear

    yield
    clear(spark)
