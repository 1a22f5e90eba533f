"""Run operators on an input whose every task fails on its first attempt
(master local[4,3] lets Spark retry); print the results as JSON."""

import json
import sys

sys.path.insert(0, sys.argv[1])

import numpy as np  # noqa: E402
from pyspark import TaskContext  # noqa: E402

from rowmill.operators import kmeans, moments, nmi  # noqa: E402
from rowmill.plans.queries import emb  # noqa: E402
from rowmill.session import get_spark  # noqa: E402

flaky = sys.argv[2] == "flaky"
spark = get_spark("local[4,3]", shuffle_partitions=4)
e = emb(spark, "/root/testdata/sf0.001").withColumnRenamed("vec_id", "id").repartition(4, "id")


def fail_first_attempt(batches):
    ctx = TaskContext.get()
    if flaky and ctx.attemptNumber() == 0:
        raise RuntimeError("injected task failure")
    yield from batches


src = e.mapInArrow(fail_first_attempt, e.schema)
m = moments.moments(src, "features", 64, "label", 10, "class", method="arrow")
fit = kmeans.kmeans_fit(src, "features", 4, 64, max_iter=5, order_by="id", epsilon=0.0)
score = nmi.nmi(kmeans.assign(src, "features", fit.centers, keep=["label"]), "label", "prediction").first()
print(json.dumps({"xx": np.round(m.xx, 10).tolist(), "centers": np.round(fit.centers, 10).tolist(),
                  "nmi": round(score["nmi_arithmetic"], 12)}))
spark.stop()
