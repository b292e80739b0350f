"""Documented detection and monitoring rules."""
import datetime as dt

from pyspark.sql import functions as F

from flowlens.operators import detect as de
from flowlens.operators import monitor as mo


def test_vpn_rules(spark):
    df = spark.createDataFrame([(7.9, 1194, 1460, 1), (5.0, 443, 1380, 1), (5.0, 443, 1460, 0)],
                               "entropy_score double, dst_port long, mss long, encryption_detected int")
    assert [r.vpn_probability for r in de.vpn_likelihood(df).collect()] == ["HIGH", "MEDIUM", "LOW"]
    m = spark.createDataFrame([(1350,), (1400,), (1430,), (1460,)], "tcp_mss long")
    got = [(r.mss_vpn, r.mss_band) for r in de.mss_fingerprint(m).collect()]
    assert got == [(True, "IPsec"), (True, "OpenVPN"), (True, "WireGuard"), (False, None)]


def test_credential_stuffing_flag(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("1.1.1.1", i, i % 10 == 0, "bot", t0 + dt.timedelta(seconds=i)) for i in range(30)]
    rows += [("2.2.2.2", 1, True, "ua", t0)]
    df = spark.createDataFrame(rows, "ip string, account long, success boolean, agent string, ts timestamp")
    out = {r.ip: r for r in de.credential_stuffing(df).collect()}
    assert out["1.1.1.1"].flagged and out["1.1.1.1"].account_velocity == 30
    assert not out["2.2.2.2"].flagged


def test_psi_alerts_and_retention(spark):
    train = spark.range(0, 1000).select(F.col("id").cast("double").alias("x"))
    same = mo.psi(train, train, "x").first()
    shifted = mo.psi(train, spark.range(0, 1000).select((F.col("id") + 800).cast("double").alias("x")), "x").first()
    assert same.psi < 1e-9 and not same.drift_alert and shifted.drift_alert
    lat = spark.createDataFrame([(dt.datetime(2024, 1, 1), 350.0), (dt.datetime(2024, 1, 1, 0, 1), 100.0)],
                                "window_start timestamp, p99_ms double")
    assert mo.alerts(latency=lat).count() == 1
    now = dt.datetime(2024, 1, 10)
    d = spark.createDataFrame([(1, now - dt.timedelta(hours=1), "10.0.0.1"), (2, now - dt.timedelta(days=2), "10.0.0.2"),
                               (3, now - dt.timedelta(days=9), "10.0.0.3")], "id long, ts timestamp, src_ip string")
    p = {r.id: r.src_ip for r in mo.pseudonymize(mo.drop_expired(d, now, 7), now, ip_cols=("src_ip",), salt="s").collect()}
    assert p[1] == "10.0.0.1" and len(p[2]) == 64 and 3 not in p


def test_review_queue(spark):
    dec = spark.createDataFrame([(1, "ALLOW"), (2, "BLOCK")], "id long, action string")
    fb = spark.createDataFrame([(1, "BLOCK"), (2, "BLOCK")], "id long, true_action string")
    assert [r.id for r in mo.review_queue(dec, fb).collect()] == [1]
