"""A2, A5: what crosses the network, and how much a search for quantiles reads."""
import random

from pyspark.sql import functions as F

from flowlens.operators import align as al
from flowlens.operators import clean as cl
from flowlens.operators import stats as st
from flowlens.plans import catalog
from flowlens.sources import fixtures as fx


def test_later_passes_read_written_rows_of_the_range(spark, monkeypatch):
    rng = random.Random(3)
    values = [rng.gauss(0, 1) for _ in range(6000)]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(5)
    inner, read = st._kth, []

    def kth(cur, ks, *rest):
        read.append((cur.count(), cur.inputFiles()))
        return inner(cur, ks, *rest)

    monkeypatch.setattr(st, "_kth", kth)
    ks = [1500, 1501, 4499, 4500]
    assert st.kth_smallest(df, "x", ks, fanout=4, exact=20) == {k: sorted(values)[k] for k in ks}
    assert len(read) > 1 and all(files and n < 600 for n, files in read[1:])


def test_flows_are_deduplicated_as_they_are_read(spark):
    """The rows are those of the aligned flows, with defaults added after the exchange."""
    sf = "/root/testdata/sf0.001"
    d = catalog.deduped_flows(spark, sf)
    want = cl.dedupe_flows(al.align(fx.flows(spark, sf)), catalog.FLOW_ORDER)
    assert d.schema.names == want.schema.names and d.exceptAll(want).count() == 0 == want.exceptAll(d).count()
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window"):]
    assert "mean_iat_total" in plan and "mean_iat_total" not in window


def test_null_and_unknown_addresses_stay_one_key(spark):
    df = spark.createDataFrame([(None, 1), ("Unknown", 2), ("nan", 3), ("a", 4)], "src_ip string, n int") \
        .withColumns({"dst_ip": F.lit("b"), "src_port": F.lit(1), "dst_port": F.lit(2), "protocol": F.lit(6)})
    got = cl.dedupe_flows(al.coerce_types(df, cl.FIVE_TUPLE), ["n"])
    assert sorted((r.src_ip, r.n) for r in got.collect()) == [("Unknown", 1), ("a", 4)]
