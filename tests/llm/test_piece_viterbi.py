import random
import re
import zlib

import numpy as np
import public_tokenizers
import sentencepiece

from flowlens.llm import piece_viterbi as pv

from .conftest import ODD, SF

PATH = public_tokenizers.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)


def brute(text, model):
    """Ids of the best segmentation of the whole text, one path at a time."""
    scores = {SP.id_to_piece(i).replace(pv.MARK, " "): (SP.get_score(i), i) for i in range(SP.get_piece_size())
              if not (SP.is_byte(i) or SP.is_control(i) or SP.is_unknown(i))}
    out = []
    for word in re.findall(" +[^ ]*|[^ ]+", " " + text.replace(pv.MARK, " ")) if text else []:
        best = [(0.0, [])]
        for end in range(1, len(word) + 1):
            last = best[end - 1]
            top = (last[0] + model.unknown, last[1] + [3 + b for b in word[end - 1].encode()])
            for k in range(1, min(16, end) + 1):
                piece = scores.get(word[end - k:end])
                if piece and best[end - k][0] + piece[0] >= top[0]:
                    top = (best[end - k][0] + piece[0], best[end - k][1] + [piece[1]])
            best.append(top)
        out += best[-1][1]
    return out


def ids_of(texts):
    return [np.frombuffer(i, np.int32).tolist() for i in pv.pieces(PATH).encode(texts)]


def test_best_segmentations(spark, monkeypatch):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("the aionÉé  \n\tÿ😀中1.") for _ in range(rnd.randint(0, 25))) for _ in range(300)]
    texts += [r.text[:400] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(20).collect()]
    want = [brute(t, pv.pieces(PATH)) for t in texts]
    assert ids_of(texts) == want
    monkeypatch.setattr(pv, "CACHE", 30)  # also with a cache that overflows
    assert [ids_of([t])[0] for t in texts] == want


def test_round_trip_and_the_library_decodes_alike():
    texts = ["a  b\n\tc", " lead", "trail  ", "😀ÿ é́", "x" * 3000, "▁mark", "a\x00b"]
    ids = pv.pieces(PATH).encode(texts)
    assert pv.pieces(PATH).decode(ids) == [t.replace(pv.MARK, " ") for t in texts]
    assert [SP.decode(np.frombuffer(i, np.int32).tolist()) for i in ids] == [t.replace(pv.MARK, " ") for t in texts]


def test_query_rows(odd, docs):
    got = pv.encode_and_decode(odd, PATH).collect()
    assert len(got) == len(ODD) and all(r.round_trip for r in got)
    assert {r.n_pieces for r in got if r.doc_id in (1, 2)} == {0}
    lists = pv.piece_ids(odd, PATH).collect()
    assert sorted(zlib.crc32(np.array(r.ids, np.int32).tobytes()) for r in lists) == sorted(r.ids_crc32 for r in got)
    assert pv.encode_and_decode(docs([]), PATH).count() == 0
