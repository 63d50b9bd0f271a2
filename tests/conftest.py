import pytest

from framewright.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(cores="4", shuffle_partitions=4, memory="4g")


@pytest.fixture(autouse=True)
def uncached(spark):
    yield
    spark.catalog.clearCache()
