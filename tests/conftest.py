import os
import sys
import tempfile

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]


@pytest.fixture(scope="session")
def spark():
    from mealops.session import get_session
    s = get_session(master="local[4]", shuffle_partitions=8,
                    extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="mealops-test-ckpt-")})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def bound(spark):
    from mealops.sources.bind import Bound
    from support import SMALL
    return Bound(spark, SMALL)
