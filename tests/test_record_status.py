"""Damaged record files: set aside, the run goes on."""
from flowlens.sources import status as st


def test_damaged_and_empty_files_of_each_kind(spark, tmp_path):
    files = {
        "csv/good.csv": "time,source_ip,dport\n2024-01-01 00:00:00,10.0.0.1,80\n",
        "csv/bad.csv": "src,ts\n1.1.1.1,2024-01-02 00:00:00\n2.2.2.2,2024-01-02 00:00:00,more\n3.3.3.3\n",
        "csv/head.csv": "src,_corrupt\n",
        "json/good.json": '[{"src": "1.1.1.1"}, {"src": "2.2.2.2"}]',
        "json/bad.json": '[{"src": "3.3.3.3"}, {"src": ',
        "txt/good.flow": "2024-01-01T00:00:00 1.1.1.1:5 > 2.2.2.2:6 TCP 60\n",
        "txt/bad.flow": "# comment\n\nno\n2024-01-01T00:00:00 1.1.1.1:5 > 2.2.2.2:6 TCP 60\n",
        "txt/none.flow": "# comment\n",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    folders = {"csv": str(tmp_path / "csv"), "json": str(tmp_path / "json"), "flow_txt": str(tmp_path / "txt")}
    records, bad = st.read_checked(spark, folders)
    got = {r.source_path.rsplit("/", 2)[1] + "/" + r.source_path.rsplit("/", 1)[1]: (r.records, r.bad_records, r.status)
           for r in st.file_status(records, bad, st.listed(spark, folders)).collect()}
    assert got == {"csv/good.csv": (1, 0, "SUCCESS"), "csv/bad.csv": (1, 2, "ERROR"), "csv/head.csv": (0, 0, "EMPTY"),
                   "json/good.json": (2, 0, "SUCCESS"), "json/bad.json": (0, 1, "ERROR"),
                   "txt/good.flow": (1, 0, "SUCCESS"), "txt/bad.flow": (1, 1, "ERROR"), "txt/none.flow": (0, 0, "EMPTY")}
    shown = {r.record for r in bad.collect()}
    assert "3.3.3.3" in shown and "no" in shown and "2.2.2.2,2024-01-02 00:00:00,more" in shown


def test_no_files_of_a_kind(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    good, bad = st.csv_records(spark, str(tmp_path / "csv"))
    assert good.count() == bad.count() == 0
