import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from terrier.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # on a few rows, compiling is most of the time: keep to the quick compiler
    session = local_session(8, "terrier-tests", **{
        "spark.sql.shuffle.partitions": "4",
        "spark.driver.extraJavaOptions": "-XX:TieredStopAtLevel=1"})
    yield session
    session.stop()


def rows(df, *columns):
    """Rows as sorted tuples, nulls last."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()),
                  key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))
