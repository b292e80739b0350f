"""The shared folder, its stages, and the package on the executors."""
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from flowlens import session
from flowlens.operators import dpi

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_stages_have_folders_of_their_own_and_go(spark):
    a, b = session.Scratch(spark, "x"), session.Scratch(spark, "x")
    assert a.root != b.root
    one, two = a.write(spark.range(3), "one"), a.write(spark.range(0), "two")
    assert one.count() == 3 and two.count() == 0
    a.keep_only("two")
    with pytest.raises(Exception):
        spark.read.parquet(a.path("one")).count()
    assert a.write(spark.range(2), "one").count() == 2
    a.keep_only()


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())


def test_executors_have_the_package_wherever_the_driver_starts(tmp_path):
    code = (f"import sys; sys.path.insert(0, {REPO!r})\n"
            "from flowlens.session import local_session\n"
            "from flowlens.sources import pcap\n"
            "spark = local_session(2)\n"
            f"sys.path.remove({REPO!r})\n"
            f"pcap.write_capture({str(tmp_path / 'a.pcap')!r}, [(1, '1.1.1.1', 1, '2.2.2.2', 2, 17, 0, b'x')])\n"
            f"print('PACKETS', pcap.read_captures(spark, {str(tmp_path)!r}).count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "PACKETS 1" in out.stdout, out.stderr[-2000:]


def test_no_syn_at_all_gives_zero_columns(spark):
    schema = "packet_no long, ts_us long, src_ip string, src_port long, dst_ip string, dst_port long, protocol long, " \
             "flags long, ttl long, win long, mss long, opts long"
    rows = [(1, 1, "a", 1, "b", 2, 6, 16, 64, 5, 1400, 1), (2, 2, "c", 1, "d", 2, 6, 2, 60, 5, 1300, 1)]
    flows = spark.createDataFrame([("a", 1, "b", 2)], "src_ip string, src_port long, dst_ip string, dst_port long")
    for n, mss in ((1, 0), (2, None)):
        syn = dpi.first_syn(spark.createDataFrame(rows[:n], schema))
        assert dpi.join_handshake(flows, syn).first().tcp_mss == mss
    assert F is not None
