import random
import re

import numpy as np
import pyarrow as pa

from flowlens.llm import bin_packing as bp
from flowlens.llm import token_store as ts
from flowlens.llm.queries import vocabulary
from flowlens.llm.text import trimmed, utf8

PATH = vocabulary("word_bpe_49k.json")


def resident():
    """MB of this process."""
    with open("/proc/self/smaps_rollup") as f:
        return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", f.read()))) / 1024


def test_a_worker_gives_freed_memory_back():
    def run(batches):
        for _ in batches:
            held = [np.ones(12_000) for _ in range(3000)]  # 288 MB, each array under malloc's mmap threshold
            held = held[-1:]  # the last one pins the heap's top
            yield held[0]

    before = resident()
    last = list(trimmed(run)([None]))
    assert len(last) == 1 and resident() < before + 60


def test_lengths_keep_no_ids_of_words(spark, docs, monkeypatch):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(["a", "B", "é", "漢", "7", ",", " ", "\n", "wörter "]) for _ in range(rnd.randrange(400))) for _ in range(300)]
    texts += [None, "", " \t ", "x " * 5000]
    data, offsets = utf8(pa.array(texts))
    counts, ids = ts.WordCounts(PATH), ts.WordIds(PATH)
    stops = ids.encode(data, offsets, ts.END_ID)[1]
    monkeypatch.setattr(ts, "AT_ONCE", 7)
    assert counts.count(data, offsets).tolist() == np.diff(stops).tolist()
    assert counts.keys.tolist() == ids.keys.tolist() and counts.size.tolist() == ids.size.tolist()
    assert sum(x.nbytes for x in vars(counts).values() if isinstance(x, np.ndarray) and x is not counts.ends) == 12 * len(counts.keys)
    monkeypatch.setattr(ts, "CACHE", 50)
    assert counts.count(data, offsets).tolist() == np.diff(stops).tolist()
    got = {r.id: r.n for r in bp.lengths(docs(list(enumerate(texts))), "doc_id", "text", *[bp.F.lit("x")] * 2, PATH).collect()}
    assert [got[i] for i in range(len(texts))] == np.diff(stops).tolist()
