import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from settings import SF_SMALL  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from rowmill.session import get_spark

    s = get_spark("local[4]", app="rowmill-tests", shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def emb(spark):
    from rowmill.plans.queries import emb as read_emb

    return read_emb(spark, SF_SMALL).withColumnRenamed("vec_id", "id").cache()


@pytest.fixture(scope="session")
def emb_np(emb):
    import numpy as np

    rows = emb.orderBy("id").collect()
    return (np.array([r["id"] for r in rows]), np.array([r["label"] for r in rows]),
            np.array([r["features"] for r in rows], dtype=float))


@pytest.fixture(scope="session")
def lineitem(spark):
    from rowmill.plans.queries import li

    return li(spark, SF_SMALL).cache()


@pytest.fixture(scope="session")
def li_np(lineitem):
    import numpy as np

    rows = lineitem.collect()
    return (np.array([r["features"] for r in rows], dtype=float),
            np.array([r["label"] for r in rows], dtype=float))
