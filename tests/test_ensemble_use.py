"""The summed ensemble corridor: the cells of ensemble(), added up inside the tasks."""

import numpy as np
from pyspark.sql import functions as F

from fauntrack.operators import posterior
from fauntrack.plans import catalog


def test_ensemble_use_sums_the_cells(spark, sf_dir):
    events = catalog._few(spark, sf_dir)
    rest = catalog.X.units(spark, sf_dir), catalog.X.edges(spark, sf_dir), catalog._parameters(spark), catalog.N
    cells = posterior.ensemble(events, *rest).groupBy("s_idx").agg(F.sum("prob").alias("prob"))
    one, two = (df.orderBy("s_idx").toPandas() for df in (cells, posterior.ensemble_use(events, *rest)))
    assert one["s_idx"].tolist() == two["s_idx"].tolist() and np.allclose(one["prob"], two["prob"], rtol=1e-9)


def test_the_query_deals_events_over_all_tasks(spark, sf_dir, monkeypatch):
    given = []
    kept = posterior.dealt

    def watch(events, *a):
        df = kept(events, *a)
        given.append(df.rdd.getNumPartitions())
        return df

    monkeypatch.setattr(posterior, "dealt", watch)
    catalog.queries()["bayesian_ensemble"](spark, sf_dir)
    assert given == [int(spark.conf.get("spark.sql.shuffle.partitions"))]
