"""Chat formatting with prefix trees.

Conversations become arrays of (role, text) turns. Those with the same first
turns share the nodes of a prefix tree: sorted by their turns, conversations
come in depth-first order, and each adds only the nodes after the longest
prefix it shares with the one before. A pack is a stretch of that order up to
``pack_chars``: its stream holds the template text of every node once, depth
first, one token being one code point. Every node has its start and end in the
stream, the position id of its first token (its offset in its own
conversation), the intervals of the stream it attends to (its ancestors),
and, for assistant turns, the interval under the loss mask. A tree that is
larger than a pack goes on in the next pack, which repeats the ancestors, so
no tree's rows meet in one task. Equal conversations are one path, held once
with all their ids beside.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n``. In texts and roles,
``<`` with any backslashes and ``|`` gets one more backslash, so control
strings cannot occur; line feeds and backslashes in roles are escaped, too.

Defined cases: a null text or role is empty; rows are ordered by turn (null
last), then role and text, so ties and repeated rows have one order; rows with
a null conv_id form one conversation with a null id. Only the four named
columns are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, small_batches, staged

START, END = "<|im_start|>", "<|im_end|>\n"
_PLAIN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_ROLE = re.compile(r"\\(.)")

_PACK = "stream string, nodes array<struct<parent:int,start:long,end:long,position:long,loss_start:long,loss_end:long,ancestors:array<struct<start:long,end:long>>>>, leaves array<struct<path_id:long,node:int>>"


def escape(text: str) -> str:
    return _PLAIN.sub(r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "|" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return _ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def merge_intervals(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Adjacent intervals as one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


class Pack:
    """A stretch of the depth-first order being emitted."""

    def __init__(self):
        self.text, self.size, self.nodes, self.path, self.leaves = [], 0, [], [], []

    def add(self, path_id: int, turns: list[tuple[str, str]], shared: int) -> None:
        """Add the turns after the first ``shared``, which the last path has, too."""
        del self.path[shared:]
        for role, text in turns[shared:]:
            head, body = f"{START}{escape_role(role)}\n", escape(text)
            piece = head + body + END
            above = [(self.nodes[i]["start"], self.nodes[i]["end"]) for i in self.path]
            loss = role == "assistant"
            start = self.size
            self.nodes.append({
                "parent": self.path[-1] if self.path else -1, "start": start, "end": start + len(piece), "position": sum(b - a for a, b in above),
                "loss_start": start + len(head) if loss else None, "loss_end": start + len(head) + len(body) if loss else None,
                "ancestors": [{"start": a, "end": b} for a, b in merge_intervals(above)],
            })
            self.path.append(len(self.nodes) - 1)
            self.text.append(piece)
            self.size += len(piece)
        self.leaves.append({"path_id": path_id, "node": self.path[-1]})

    def row(self) -> dict:
        return {"stream": "".join(self.text), "nodes": self.nodes, "leaves": self.leaves}


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_NODE = pa.struct([("parent", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("position", pa.int64()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("ancestors", pa.list_(_SPAN))])
_PACK_ARROW = pa.schema([("stream", pa.string()), ("nodes", pa.list_(_NODE)), ("leaves", pa.list_(pa.struct([("path_id", pa.int64()), ("node", pa.int32())])))])


def gathered(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's (role, text) in order."""
    row = F.struct(F.col("turn").isNull().alias("a"), F.col("turn").alias("b"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = F.sort_array(F.collect_list(row))
    return turns.groupBy("conv_id").agg(ordered.alias("rows")).select("conv_id", F.transform("rows", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def pack(paths: DataFrame, pack_chars: int = 1 << 18) -> DataFrame:
    """Packs of (path_id, turns) rows whose turns are distinct."""

    def emit(batches):
        held, before, made = Pack(), [], []
        for batch in batches:
            for path_id, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                now = [(x["role"], x["text"]) for x in turns]
                if held.size >= pack_chars:
                    made.append(held.row())
                    held, before = Pack(), []
                shared = 0
                while shared < min(len(before), len(now)) and before[shared] == now[shared]:
                    shared += 1
                held.add(path_id, now, shared)
                before = now
            if made:
                yield pa.RecordBatch.from_pylist(made, schema=_PACK_ARROW)
                made = []
        if held.leaves:
            yield pa.RecordBatch.from_pylist([held.row()], schema=_PACK_ARROW)

    width = shuffle_width(paths.sparkSession)
    return small_batches(paths).select("path_id", "turns").repartitionByRange(width, "turns").sortWithinPartitions("turns").mapInArrow(emit, _PACK)


def parse(stream: str, spans: list[tuple[int, int]], losses: list[tuple[int, int]]) -> tuple[list[tuple[str, str]], str, int]:
    """Turns, text under the loss mask and length of one conversation."""
    whole = "".join(stream[a:b] for a, b in spans)
    turns = []
    for piece in whole.split(START)[1:]:
        role, text = piece.removesuffix(END).split("\n", 1)
        turns.append((unescape_role(role), unescape(text)))
    return turns, "".join(unescape(stream[a:b]) for a, b in losses), len(whole)


_READ = "path_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(packs: DataFrame) -> DataFrame:
    """What each path's conversation says, read from the packs by its intervals."""

    def read(batches):
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                nodes = x["nodes"]
                for leaf in x["leaves"]:
                    node = nodes[leaf["node"]]
                    spans = [(s["start"], s["end"]) for s in node["ancestors"]] + [(node["start"], node["end"])]
                    chain, at = [], leaf["node"]
                    while at >= 0:
                        chain.append(nodes[at])
                        at = nodes[at]["parent"]
                    losses = [(n["loss_start"], n["loss_end"]) for n in reversed(chain) if n["loss_start"] is not None]
                    turns, loss, chars = parse(x["stream"], spans, losses)
                    digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                    rows.append((leaf["path_id"], len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["path_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return packs.mapInArrow(read, _READ)


def format_conversations(turns: DataFrame, pack_chars: int = 1 << 18) -> tuple[DataFrame, DataFrame]:
    """(packs, members): the stored packs, and (conv_id, path_id) of all conversations."""
    convs = staged(gathered(turns).withColumn("key", F.sha2(F.to_json(F.struct("turns")), 256)), "chat-turns")
    paths = convs.groupBy("key").agg(F.min("turns").alias("turns"), F.min(F.struct(F.col("conv_id").isNull(), F.col("conv_id"))).alias("least"))
    numbered = staged(paths.select("key", "turns").withColumn("path_id", F.monotonically_increasing_id()), "chat-paths")
    packs = staged(pack(numbered, pack_chars), "chat-packs")
    return packs, convs.select("conv_id", "key").join(numbered.select("key", "path_id"), "key").select("conv_id", "path_id")


def format_and_read(turns: DataFrame) -> DataFrame:
    """One row per conversation, read back from the packs."""
    packs, members = format_conversations(turns)
    return members.join(read_back(packs), "path_id").drop("path_id")
