from pyspark.sql import functions as F

from flowlens.functions import parse as ps
from flowlens.functions.exprs import ratio
from flowlens.operators import logs as lg
from flowlens.operators import unify as un


def test_kv_parser_cases(spark):
    lines = ['user="" x=1', "a=b=c", "k=1 k=2", "# comment k=v", "", "   "]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i int, line string")
    got = {r.i: r.m for r in df.select("i", ps.kv_map(F.col("line")).alias("m")).collect()}
    assert got[0]["user"] == "" and got[0]["x"] == "1"
    assert got[1]["a"] == "b=c"
    assert got[2]["k"] == "2"
    assert got[3] is None and got[4] is None and got[5] is None


def test_label_inference_default_and_fixed(spark):
    vals = ["novpn", "benign", "torrent", "yes", "", "7"]
    df = spark.createDataFrame([(v,) for v in vals], "l string")
    d = [r[0] for r in df.select(ps.infer_label_num(ps.standardize_label(F.col("l")))).collect()]
    assert d == [1, 0, 1, 1, None, None]
    f = [r[0] for r in df.select(ps.infer_label_num(ps.standardize_label(F.col("l")), True)).collect()]
    assert f[0] == 0


def test_protocol_normalisation(spark):
    df = spark.createDataFrame([("6",), ("udp",), ("TCP/HTTP",), ("99",), (None,)], "p string")
    assert [r[0] for r in df.select(ps.norm_protocol(F.col("p"))).collect()] == ["TCP", "UDP", "TCP", "99", ""]


def test_ratio_rules(spark):
    df = spark.createDataFrame([(5, 0)], "n long, d long")
    r = df.select(ratio("n", "d", "numerator"), ratio("n", "d", "zero"), ratio("n", "d", "one")).first()
    assert tuple(r) == (5.0, 0.0, 5.0)


def test_firewall_zero_sent_bytes_keeps_row(spark):
    df = spark.createDataFrame([(1, "srcip=1.1.1.1 dstip=2.2.2.2 sentbyte=0 rcvdbyte=5 sessionid=9")],
                               "line_no long, line string")
    r = lg.firewall_flows(df, order_cols=["line_no"]).first()
    assert r.down_up_ratio == 0.0 and r.byte_ratio == 0.0 and r.byte_count_total == 5


def test_alias_zero_is_falsy(spark):
    df = spark.createDataFrame([("0", "8", "2024-01-01 00:00:00")], "src_port string, sport string, ts string")
    r = un.normalize(df, "csv").first()
    assert r.src_port == "8" and r.timestamp == "2024-01-01T00:00:00"


def test_epoch_to_iso(spark):
    df = spark.createDataFrame([("1704067207.5",), ("not a time",), (None,)], "t string")
    assert [r[0] for r in df.select(ps.to_iso(F.col("t"))).collect()] == \
        ["2024-01-01T00:00:07.500000", "not a time", ""]


def test_capture_reader_round_trip(spark, tmp_path):
    from flowlens.sources.pcap import read_captures, write_capture
    pk = [(1_000_000, "10.0.0.1", 1234, "10.0.0.2", 80, 6, 2, b""),
          (1_500_000, "10.0.0.2", 80, "10.0.0.1", 1234, 6, 18, b"hi"),
          (2_000_000, "10.0.0.1", 5353, "10.0.0.9", 53, 17, 0, b"q")]
    write_capture(str(tmp_path / "a.pcap"), pk)
    rows = read_captures(spark, str(tmp_path)).orderBy("packet_no").collect()
    assert [(r.ts_us, r.src_ip, r.src_port, r.dst_port, r.protocol, r.flags) for r in rows] == \
        [(1_000_000, "10.0.0.1", 1234, 80, 6, 2), (1_500_000, "10.0.0.2", 80, 1234, 6, 18),
         (2_000_000, "10.0.0.1", 5353, 53, 17, None)]
    assert rows[1].payload == b"hi" and rows[0].source_file == "a.pcap"


def test_flow_text_and_json_sources(spark, tmp_path):
    from flowlens.sources import files as fs
    (tmp_path / "f.txt").write_text("# header\n\n1704067200.5 10.0.0.1:1234 > 10.0.0.2:80 TCP 60 vpn\n"
                                    "1704067201 10.0.0.3:5 10.0.0.4:6 UDP\n")
    r = fs.read_flow_text(spark, str(tmp_path / "f.txt")).orderBy("line_no").collect()
    assert (r[0].timestamp, r[0].src_port, r[0].dst_ip, r[0].protocol, r[0].label) == \
        ("2024-01-01T00:00:00.500000", "1234", "10.0.0.2", "TCP", "vpn")
    # without an arrow the arrow is assumed at token 2, so the 4th token is the destination
    assert (r[1].dst_ip, r[1].protocol, r[1].packet_len) == ("UDP", "", "")
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('[{"src": "1.1.1.1", "dst": "2.2.2.2", "x": 5}, 3]')
    (tmp_path / "j" / "b.json").write_text('{"train": [{"src_ip": "3.3.3.3"}], "test": [{"src_ip": "4.4.4.4"}]}')
    (tmp_path / "j" / "c.json").write_text('{"source_ip": "5.5.5.5", "time": 0}')
    j = {r.src_ip: r for r in fs.read_json_records(spark, str(tmp_path / "j")).collect()}
    assert set(j) == {"1.1.1.1", "3.3.3.3", "4.4.4.4", "5.5.5.5"}
    # every key that is not a unified column name is spilled, aliases included (as the reference)
    assert j["1.1.1.1"].additional_meta == '{"src":"1.1.1.1","dst":"2.2.2.2","x":"5"}'
    assert '"__subset":"train"' in j["3.3.3.3"].additional_meta
    assert j["5.5.5.5"].timestamp == ""  # 0 is falsy, as in the reference


def test_label_helpers(spark):
    df = spark.createDataFrame([("/d/DoS-Hulk-no-metadata.parquet", "img_Chat_x.pcap.png", "vpn-chat"),
                                ("Benign-no-metadata.parquet", "img_Video.pcap_1.png", "Browsing")],
                               "path string, img string, label string")
    r = df.select(ps.label_from_file_stem(F.col("path")).alias("a"), ps.label_from_image_name(F.col("img")).alias("b"),
                  ps.is_vpn_target(F.col("label")).alias("c")).collect()
    assert [tuple(x) for x in r] == [("DoS Hulk", "Chat", 1), ("Benign", "Video", 0)]
    from flowlens.operators import split as sp
    s = sp.stage2(spark.createDataFrame([("Unknown",), ("DoS",)], "intent_label string"), relabel_unknown=True)
    assert [x.intent_label for x in s.collect()] == ["Unclassified", "DoS"]
