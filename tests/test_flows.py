from pyspark.sql import functions as F

from conftest import PACKET_SCHEMA, SF, packet
from flowlens.operators import flows as fl
from flowlens.sources import fixtures as fx


def _flows(spark, rows, **kw):
    return fl.build_flows(spark.createDataFrame(rows, PACKET_SCHEMA), **kw)


def test_gap_equal_to_timeout_stays_in_flow(spark):
    rows = [packet(1, 0.0, "10.0.0.1", 1000, "10.0.0.2", 80),
            packet(2, 60.0, "10.0.0.1", 1000, "10.0.0.2", 80),
            packet(3, 120.000001, "10.0.0.1", 1000, "10.0.0.2", 80)]
    out = _flows(spark, rows, idle_timeout=60.0).orderBy("start_us").collect()
    assert [r.packet_count_total for r in out] == [2, 1]


def test_bucket_width_never_changes_result(spark):
    rows = [packet(i, t, "10.0.0.1", 1000, "10.0.0.2", 80) for i, t in
            enumerate([0, 5, 50, 200, 230, 231, 400, 1000, 1001, 1059, 1120])]
    rows += [packet(100 + i, t, "10.0.0.2", 80, "10.0.0.1", 1000, length=60) for i, t in
             enumerate([1, 6, 220, 1002, 1100])]
    ref = sorted(map(tuple, _flows(spark, rows, idle_timeout=60.0, bucket=10_000).collect()))
    for b in (7, 30, 59, 61, 333):
        got = sorted(map(tuple, _flows(spark, rows, idle_timeout=60.0, bucket=b).collect()))
        assert got == ref, b


def test_equal_ips_key_modes(spark):
    rows = [packet(1, 0.0, "127.0.0.1", 5000, "127.0.0.1", 6000),
            packet(2, 1.0, "127.0.0.1", 6000, "127.0.0.1", 5000)]
    assert _flows(spark, rows, key="ip").count() == 2
    assert _flows(spark, rows, key="endpoint").count() == 1


def test_one_packet_per_direction_has_zero_iat(spark):
    rows = [packet(1, 0.0, "10.0.0.1", 1, "10.0.0.2", 2), packet(2, 1.0, "10.0.0.2", 2, "10.0.0.1", 1)]
    r = _flows(spark, rows).first()
    assert (r.mean_iat_fwd, r.mean_iat_bwd, r.std_iat_total) == (0.0, 0.0, 0.0)
    assert r.flow_duration == 1.0 and r.packet_count_fwd == 1 and r.packet_count_bwd == 1


def test_capture_order_ignores_negative_gap(spark):
    rows = [packet(1, 10.0, "10.0.0.1", 1, "10.0.0.2", 2), packet(2, 5.0, "10.0.0.1", 1, "10.0.0.2", 2),
            packet(3, 12.0, "10.0.0.1", 1, "10.0.0.2", 2)]
    r = _flows(spark, rows, order="capture", idle_timeout=None).first()
    assert r.mean_iat_fwd == 7.0  # only the 5 -> 12 gap is kept


def test_only_zero_windows_gives_minus_one(spark):
    rows = [packet(1, 0.0, "10.0.0.1", 1, "10.0.0.2", 2, win=0)]
    assert _flows(spark, rows).first().window_size == -1


def test_flags_count_tcp_only(spark):
    rows = [packet(1, 0.0, "10.0.0.1", 1, "10.0.0.2", 2, flags=2),
            packet(2, 0.5, "10.0.0.1", 1, "10.0.0.2", 2, flags=18),
            packet(3, 1.0, "10.0.0.1", 9, "10.0.0.2", 2, flags=2, proto=17)]
    out = {r.protocol: r for r in _flows(spark, rows).collect()}
    assert out[6].syn_flag_count == 2 and out[6].ack_flag_count == 1
    assert out[17].syn_flag_count == 0


def test_packets_conserved_and_partitioning_independent(spark):
    p = fx.packets(spark, SF)
    a = fl.build_flows(p, idle_timeout=60.0)
    assert a.agg(F.sum("packet_count_total")).first()[0] == p.count()
    b = fl.build_flows(p.repartition(7, "packet_no"), idle_timeout=60.0, bucket=45)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_hot_key_holding_half_the_packets(spark):
    """One key owns half of all packets: small time buckets (many tasks for
    the hot key) give exactly the flows of one whole-timeline window."""
    p = fx.packets(spark, SF)
    hot = p.withColumns({"src_ip": F.lit("10.9.9.9"), "dst_ip": F.lit("93.184.216.9"),
                         "src_port": F.lit(5555).cast("bigint"), "dst_port": F.lit(443).cast("bigint"),
                         "protocol": F.lit(6).cast("bigint"),
                         "packet_no": F.col("packet_no") + F.lit(10_000_000)})
    both = p.unionByName(hot)
    small = fl.build_flows(both, idle_timeout=60.0, bucket=30)
    whole = fl.build_flows(both, idle_timeout=60.0, bucket=10 ** 9)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, whole.collect()))
    assert small.where("src_ip = '10.9.9.9'").agg(F.sum("packet_count_total")).first()[0] == p.count()
