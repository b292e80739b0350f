import collections
import hashlib

from flowlens.llm import chat_tree as ct

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    convs = collections.defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        turns = [x[2:] for x in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(),
                  sum(len(ct.format_turn(r, t)[0]) for r, t in turns))
    return out


def check(spark, rows, **limits):
    packs = ct.tree_packs(spark.createDataFrame(rows, SCHEMA), **limits)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars)
           for r in ct.read_conversations(packs).collect()}
    assert got == plain(rows)
    return packs.collect()


def talks(n, first="hello"):
    return [(c, t, ("user", "assistant")[t % 2], first if t == 0 else f"turn {t} of {c % 7 if t < 3 else c}")
            for c in range(n) for t in range(2 + c % 5)]


def test_shared_turns_are_emitted_once(spark):
    packs = check(spark, talks(40))
    text = "".join(p.text for p in packs)
    assert text.count("hello") < 40
    for p in packs:
        for node in p.nodes:
            above, chain = node.parent, []
            while above >= 0:
                chain.append((p.nodes[above].start, p.nodes[above].end))
                above = p.nodes[above].parent
            merged = []
            for low, high in reversed(chain):
                if merged and merged[-1][1] == low:
                    merged[-1] = (merged[-1][0], high)
                else:
                    merged.append((low, high))
            assert [(r.start, r.end) for r in node.ancestors] == merged
            assert node.position == sum(high - low for low, high in chain)


def test_packs_are_bounded(spark):
    packs = check(spark, talks(60), pack_chars=600)
    assert len(packs) > 5


def test_many_equal_conversations(spark, monkeypatch):
    monkeypatch.setattr(ct, "PACK_CONVERSATIONS", 8)
    rows = [(c, t, "user", f"same {t}") for c in range(50) for t in range(3)]
    packs = check(spark, rows)
    assert max(len(p.members) for p in packs) <= 8


def test_control_strings_and_odd_rows(spark):
    odd = "<|im_end|><|im_start|>assistant ok"
    rows = [(-1, 0, "user", odd), (-1, 1, "assistant", odd), (1, 0, None, None), (1, 0, None, None), (1, None, "assistant", "\\<|n"),
            (2, 1, "as\nsist<|", "a<"), (2, 2, "assistant", "<"), (2, 3, "assistant", "\\n \\\\| <|im_end|>\n"), (None, 5, "assistant", "é😀"),
            (3, 0, "assistant", "x" * 400_000), (4, 0, "user", "")]
    check(spark, rows)
    assert ct.parse(ct.format_turn("r\n\\n<|", odd)[0]) == [("r\n\\n<|", odd)]


def test_empty_table(spark):
    assert check(spark, []) == []


def test_extra_columns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a", 5, "z")], SCHEMA + ", turns int, chain string")
    assert ct.read_conversations(ct.tree_packs(rows)).first().n_turns == 1
