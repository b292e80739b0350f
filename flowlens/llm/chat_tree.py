"""Conversations as prefix trees, each shared beginning emitted once.

A turn is written as `<|im_start|>role\\ntext<|im_end|>\\n`. Inside roles and
texts a backslash doubles and `<|` becomes `<\\|` (in roles a line break becomes
`\\n`), so no control string can arise there and every text can be had back.

Conversations are sorted by their turns, so that those with the same first
turns follow each other. A task goes through its sorted conversations with the
path of the last one: shared turns stay, the others are appended. That emits
the nodes of a tree depth-first. A pack holds one tree, or a part of one of up
to PACK_CHARS code points and PACK_CONVERSATIONS conversations, after which the
shared turns are emitted anew. So a first turn that a third of all
conversations share is dealt out over many tasks and many packs of bounded
size. A node carries the range of its code points in the pack, the position of
its first one in its conversation, the ranges of its ancestors, which are what
it may attend to besides itself, and the range under the loss mask (the text of
an assistant's turn).

Defined results: null roles and texts are empty; turns are ordered by turn,
then role, then text, null turns first; repeated rows are turns of their own;
null conversation ids make one conversation; an empty table gives no pack;
other columns are not looked at. A conversation is one row, like a document.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.session import configure

START, END = "<|im_start|>", "<|im_end|>\n"
LEARNT = "assistant"
PACK_CHARS = 1 << 18
PACK_CONVERSATIONS = 4096
#: Turns that conversations are dealt out by.
RANGE_TURNS = 16

_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and the range of its text."""
    head = f"{START}{escape(role)}\n".replace("\n", "\\n", escape(role).count("\n"))
    body = escape(text)
    return f"{head}{body}{END}", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


class Pack:
    """One packed sequence while it grows."""

    def __init__(self):
        self.parts: list[str] = []
        self.size = 0
        self.nodes: list[dict] = []
        self.members: list[dict] = []
        self.path: list[tuple[int, tuple[str, str]]] = []  # node and turn of the last conversation

    def shared(self, turns: list[tuple[str, str]]) -> int:
        k = 0
        while k < len(turns) and k < len(self.path) and self.path[k][1] == turns[k]:
            k += 1
        return k

    def add(self, conv_id: int | None, turns: list[tuple[str, str]], formatted: list[tuple[str, int, int]]) -> None:
        k = self.shared(turns)
        del self.path[k:]
        for turn, (text, low, high) in zip(turns[k:], formatted[k:]):
            parent = self.path[-1][0] if self.path else -1
            above = self.nodes[parent] if parent >= 0 else None
            ranges = list(above["ancestors"]) if above else []
            if above:
                if ranges and ranges[-1]["end"] == above["start"]:
                    ranges[-1] = {"start": ranges[-1]["start"], "end": above["end"]}
                else:
                    ranges.append({"start": above["start"], "end": above["end"]})
            learnt = turn[0] == LEARNT
            self.nodes.append({
                "parent": parent, "start": self.size, "end": self.size + len(text),
                "position": above["position"] + above["end"] - above["start"] if above else 0, "ancestors": ranges,
                "loss_start": self.size + (low if learnt else len(text)),
                "loss_end": self.size + (high if learnt else len(text))})
            self.parts.append(text)
            self.size += len(text)
            self.path.append((len(self.nodes) - 1, turn))
        self.members.append({"conv_id": conv_id, "leaf": self.path[-1][0]})

    def row(self) -> dict:
        return {"pack_id": self.members[0]["conv_id"], "text": "".join(self.parts), "nodes": self.nodes,
                "members": self.members}


RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
PACKS = pa.schema([
    ("pack_id", pa.int64()), ("text", pa.string()),
    ("nodes", pa.list_(pa.struct([("parent", pa.int64()), ("start", pa.int64()), ("end", pa.int64()),
                                  ("position", pa.int64()), ("ancestors", RANGES), ("loss_start", pa.int64()),
                                  ("loss_end", pa.int64())]))),
    ("members", pa.list_(pa.struct([("conv_id", pa.int64()), ("leaf", pa.int64())])))])
PACKS_DDL = ("pack_id long, text string, nodes array<struct<parent: long, start: long, end: long, position: long, "
             "ancestors: array<struct<start: long, end: long>>, loss_start: long, loss_end: long>>, "
             "members array<struct<conv_id: long, leaf: long>>")


def tree_packs(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
               text_col: str = "text", pack_chars: int = PACK_CHARS) -> DataFrame:
    """One row per pack: text, nodes and the conversations with their last node."""
    spark = configure(rows.sparkSession)
    turn = F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                    F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    whole = rows.groupBy(F.col(conv_col).cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    keyed = whole.withColumn("chain", F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"]))) \
        .withColumn("first_turns", F.slice("chain", 1, RANGE_TURNS))
    dealt = keyed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "first_turns", "conv_id") \
        .sortWithinPartitions("first_turns", "chain", "conv_id").select("conv_id", "turns")

    def run(batches):
        pack, done, size = Pack(), [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                for conv in batch.slice(at, 16).to_pylist():
                    turns = [(t["role"], t["text"]) for t in conv["turns"]]
                    formatted = [format_turn(*t) for t in turns]
                    k = pack.shared(turns)
                    grown = pack.size + sum(len(f[0]) for f in formatted[k:])
                    if pack.members and (k == 0 or grown > pack_chars or len(pack.members) >= PACK_CONVERSATIONS):
                        done.append(pack.row())
                        size += pack.size
                        pack = Pack()
                    pack.add(conv["conv_id"], turns, formatted)
                if size > 4 * PACK_CHARS:
                    yield pa.RecordBatch.from_pylist(done, PACKS)
                    done, size = [], 0
        if pack.members:
            done.append(pack.row())
        if done:
            yield pa.RecordBatch.from_pylist(done, PACKS)

    return dealt.mapInArrow(run, PACKS_DDL)


READ = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
        "pack_id long, first_position long, last_position long, n_ranges long")


def read_conversations(packs: DataFrame) -> DataFrame:
    """One row per conversation, from the packs alone: its text is that of its
    last node's ancestors and itself."""
    names = [c.split()[0] for c in READ.split(", ")]

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                pack = batch.slice(at, 1).to_pylist()[0]
                text, nodes, out = pack["text"], pack["nodes"], []
                for member in pack["members"]:
                    leaf = nodes[member["leaf"]]
                    formatted = "".join(text[r["start"]:r["end"]] for r in leaf["ancestors"]) + text[leaf["start"]:leaf["end"]]
                    turns = parse(formatted)
                    learnt, node = [], member["leaf"]
                    while node >= 0:
                        learnt.append(unescape(text[nodes[node]["loss_start"]:nodes[node]["loss_end"]]))
                        node = nodes[node]["parent"]
                    loss = "".join(reversed(learnt))
                    said = "".join(f"{r}\n{t}\n" for r, t in turns)
                    out.append((member["conv_id"], len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss),
                                hashlib.sha256(loss.encode()).hexdigest(), len(formatted), pack["pack_id"],
                                leaf["position"], leaf["position"] + leaf["end"] - leaf["start"] - 1,
                                len(leaf["ancestors"]) + 1))
                yield pa.RecordBatch.from_pylist([dict(zip(names, o)) for o in out], READ_SCHEMA)

    return packs.mapInArrow(run, READ)


READ_SCHEMA = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in READ.split(", ")])
