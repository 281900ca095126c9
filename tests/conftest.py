import pytest

from lakefold.session import get_spark


@pytest.fixture(scope="session")
def spark():
    session = get_spark("local[4]", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    return session
