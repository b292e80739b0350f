"""File sources and sinks that have no registered query."""
from pyspark.sql import functions as F

from flowlens.sources import files as fs
from flowlens.sources import pcap


def test_discovery_labels_and_summary(spark, tmp_path):
    for rel in ["Chat/a.pcap", "Chat/b.pcap", "Video/c.pcap", "notes.md", "x/flows.csv"]:
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"0")
    found = fs.discover_files(spark, str(tmp_path))
    assert sorted(r.extension for r in found.collect()) == ["csv", "pcap", "pcap", "pcap"]
    labels = fs.capture_labels(found.where("extension = 'pcap'"), "folder")
    assert {(r.class_name, r.label) for r in labels.collect()} == {("Chat", 0), ("Video", 1)}
    paths = {r.path.rsplit("/", 1)[1]: r.path for r in found.collect()}
    flows = spark.createDataFrame([(paths["a.pcap"],), (paths["a.pcap"],), (paths["c.pcap"],)], "source_path string")
    files = found.where("extension = 'pcap'").withColumn("error", F.when(F.col("path").endswith("c.pcap"), "cut off"))
    summ = {r.source_file: (r.flows, r.status) for r in fs.batch_summary(flows, files, 49).collect()}
    assert summ == {"a.pcap": (2, "SUCCESS"), "b.pcap": (0, "EMPTY"), "c.pcap": (1, "ERROR")}


def test_csv_files_with_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,source_ip,dport\n2024-01-01 00:00:00,10.0.0.1,80\n")
    (tmp_path / "b.csv").write_text("src,ts,extra\n10.9.9.9,2024-01-02 00:00:00,x\n")
    (tmp_path / "c.csv").write_text("src,ts,extra\n")
    got = {r.source_file: (r.timestamp, r.src_ip, r.dst_port) for r in fs.read_csv_records(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": ("2024-01-01T00:00:00", "10.0.0.1", "80"), "b.csv": ("2024-01-02T00:00:00", "10.9.9.9", "")}


def test_json_files_of_the_same_name(spark, tmp_path):
    for folder, doc in (("a", '{"one": [{"src": "1.1.1.1"}, {"src": "2.2.2.2"}], "two": []}'), ("b", '{"src": "3.3.3.3"}')):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "f.json").write_text(doc)
    got = fs.read_json_records(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).collect()
    assert sorted((r.source_path.rsplit("/", 2)[1], r.src_ip) for r in got) == [
        ("a", "1.1.1.1"), ("a", "2.2.2.2"), ("b", "3.3.3.3")]


PACKETS = [(1_700_000_000_000_000 + i * 1000, "10.0.0.1", 1000 + i, "10.0.0.2", 443, (6, 17)[i % 2], 2, b"x" * i)
           for i in range(7)]


def test_captures_of_both_formats_and_damaged_ones(spark, tmp_path):
    whole = pcap.capture_bytes(PACKETS)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.pcap").write_bytes(whole)
    (tmp_path / "x.pcap").write_bytes(pcap.capture_bytes(PACKETS[:2]))
    (tmp_path / "y.pcapng").write_bytes(pcap.capture_bytes(PACKETS, ng=True))
    (tmp_path / "ng.pcap").write_bytes(pcap.capture_bytes(PACKETS[:3], ng=True))
    (tmp_path / "cut.pcap").write_bytes(whole[:-3])
    (tmp_path / "none.pcap").write_bytes(b"hello world")
    (tmp_path / "empty.pcap").write_bytes(pcap.capture_bytes([]))
    rows = pcap.read_captures(spark, str(tmp_path)).collect()
    for name in ("y.pcapng", "ng.pcap"):
        got = sorted((r.ts_us, r.src_ip, r.src_port, r.protocol, len(r.payload)) for r in rows if r.source_file == name)
        assert got == [(p[0], p[1], p[2], p[5], len(p[7])) for p in PACKETS[:len(got)]] and len(got) in (3, 7)
    seen = {r.source_path.split(str(tmp_path))[1]: (r.packets, r.status) for r in pcap.capture_summary(spark, str(tmp_path)).collect()}
    assert seen == {"/a/x.pcap": (7, "SUCCESS"), "/x.pcap": (2, "SUCCESS"), "/y.pcapng": (7, "SUCCESS"),
                    "/ng.pcap": (3, "SUCCESS"), "/cut.pcap": (6, "ERROR"), "/none.pcap": (0, "ERROR"), "/empty.pcap": (0, "EMPTY")}


def test_labelled_flow_files(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq
    for name, i in [("DoS-Wednesday-no-metadata.parquet", 1), ("Bot-no-metadata.parquet", 2), ("other.parquet", 3)]:
        pq.write_table(pa.table({"id": [i], " Destination Port": [80]}), str(tmp_path / name))
    df = fs.read_labelled_flows(spark, str(tmp_path))
    got = {r.id: r.intent_label for r in df.collect()}
    # file stem -> label text, then the attack dictionary (unknown names pass through)
    assert got == {1: "DoS Wednesday", 2: "Botnet"}


def test_sinks_and_feature_names(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    fs.write_table(df, str(tmp_path / "pq"), partition_by=["v"])
    fs.write_table(df, str(tmp_path / "csv"), fmt="csv")
    fs.write_report(df, str(tmp_path / "rep"))
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 2
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    assert spark.read.json(str(tmp_path / "rep")).count() == 2
    names = ["duration", "total_fiat", "mean_flowiat"]
    fs.save_feature_names(spark, names, str(tmp_path / "names"))
    assert fs.load_feature_names(spark, str(tmp_path / "names")) == names


def test_token_tsv_sink(spark, tmp_path):
    from flowlens.operators.images import token_samples, write_tsv
    p = spark.createDataFrame([("b", bytes([0, 255, 16])), ("a", b"AB")], "cls string, payload binary")
    t = token_samples(p, "cls")
    got = {r.label: r.text_a for r in t.collect()}
    assert got == {0: "41 42", 1: "00 ff 10"}
    write_tsv(t, str(tmp_path / "tsv"))
    back = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "tsv"))
    assert sorted(back.columns) == ["label", "text_a"] and back.count() == 2
    assert F is not None
