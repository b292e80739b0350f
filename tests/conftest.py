import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from flowlens.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=4, shuffle_partitions=4, app="flowlens-tests")
    yield s
    s.stop()


US = 1_000_000


def packet(no, ts_s, src, sp, dst, dp, length=100, proto=6, flags=16, ttl=64, win=1024, mss=None, opts=0):
    return (no, int(round(ts_s * US)), src, sp, dst, dp, proto, length, flags, ttl, win, mss, opts)


PACKET_SCHEMA = ("packet_no long, ts_us long, src_ip string, src_port long, dst_ip string, dst_port long, "
                 "protocol long, pkt_len long, flags long, ttl long, win long, mss long, opts long")
