"""Chat formatting as prefix trees.

Conversations that share their first turns are laid side by side: each conversation becomes one row,
chained digests of all its turns make a sort key, and rows are range-partitioned by
(key, conversation), so conversations under a hot first turn spread over partitions. Every
partition then streams trees: a shared turn is emitted once, depth-first, and each node carries its
position along its path, the intervals of the emitted text that it may attend to (its ancestors),
and the span that counts for the loss. A tree is closed at ``tree_chars`` characters or
``tree_leaves`` conversations; the next one emits the shared turns again.

Template of a turn: OPEN role MIDDLE text CLOSE. Control strings inside roles and texts get a
backslash after their first character, and those that have backslashes there one more, which is
undone exactly on reading.

Defined results:
* null role or text: as the empty one. Rows are ordered by turn, then role, then text, so ties and
  repeated rows have a defined order; every row is a turn. A null turn sorts first.
* a null conv_id is a conversation of its own. An empty table gives no tree.
* only a single conversation is ever held whole, since it is one formatted value.
* other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import sliced
from quern.session import stored

OPEN, MIDDLE, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that some template gives a meaning.
CONTROL = (OPEN, MIDDLE, CLOSE, "<|im_start|>", "<|im_end|>", "<|startoftext|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")

_TAILS = {head: "|".join(re.escape(c[1:]) for c in CONTROL if c[0] == head) for head in "<["}
_ADD = re.compile("|".join(rf"{re.escape(h)}(?=\\*(?:{t}))" for h, t in _TAILS.items()))
_REMOVE = re.compile("|".join(rf"(?<={re.escape(h)})\\(?=\\*(?:{t}))" for h, t in _TAILS.items()))


def escape(text: str) -> str:
    return _ADD.sub(lambda m: m.group() + "\\", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _REMOVE.sub("", text) if "\\" in text else text


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and the span of its text."""
    head, body = OPEN + escape(role) + MIDDLE, escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse_turn(turn: str) -> tuple[str, str]:
    """The role and text of a formatted turn."""
    role, _, text = turn[len(OPEN) : -len(CLOSE)].partition(MIDDLE)
    return unescape(role), unescape(text)


_KEYED = "conv_id long, roles array<string>, texts array<string>, path string"


def _keyed(batches: Iterator[pa.RecordBatch], flush: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation become a row a conversation, with the chained digests of all its turns."""
    many = pa.list_(pa.string())
    schema = pa.schema([("conv_id", pa.int64()), ("roles", many), ("texts", many), ("path", pa.string())])
    out: list[tuple] = []
    size = 0

    def rows():
        for b in sliced(batches):
            yield from zip(*(b.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True)

    for conv, turns in groupby(rows(), key=lambda r: r[0]):
        roles, said, path, chain = [], [], [], b""
        for _, role, text in turns:
            chain = hashlib.blake2b(b"\0".join((chain, role.encode(), text.encode())), digest_size=8).digest()
            roles.append(role)
            said.append(text)
            path.append(chain.hex())
            size += len(text) + 40
        out.append((conv, roles, said, "".join(path)))
        if size > flush:
            yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


_TREE = (
    "tree long, text string, "
    "nodes array<struct<parent:int,start:int,end:int,position:int,loss_start:int,loss_end:int,"
    "ancestors:array<struct<start:int,end:int>>>>, leaves array<struct<conv_id:bigint,node:int>>"
)


class Tree:
    def __init__(self):
        self.text: list[str] = []
        self.size = 0
        self.nodes: list[dict] = []
        self.leaves: list[dict] = []
        self.path: list[tuple[int, str, str]] = []

    def add(self, conv_id, turns: list[tuple[str, str]], loss_role: str) -> None:
        shared = 0
        for (_, role, text), turn in zip(self.path, turns, strict=False):
            if (role, text) != turn:
                break
            shared += 1
        self.path = self.path[:shared]
        for role, text in turns[shared:]:
            turn, a, b = format_turn(role, text)
            parent = self.path[-1][0] if self.path else -1
            up = self.nodes[parent] if parent >= 0 else None
            seen = [dict(x) for x in up["ancestors"]] if up else []
            if up and seen and seen[-1]["end"] == up["start"]:
                seen[-1]["end"] = up["end"]
            elif up:
                seen.append({"start": up["start"], "end": up["end"]})
            start = self.size
            counts = role == loss_role
            self.nodes.append(
                {
                    "parent": parent,
                    "start": start,
                    "end": start + len(turn),
                    "position": up["position"] + up["end"] - up["start"] if up else 0,
                    "loss_start": start + a if counts else start,
                    "loss_end": start + b if counts else start,
                    "ancestors": seen,
                }
            )
            self.text.append(turn)
            self.size += len(turn)
            self.path.append((len(self.nodes) - 1, role, text))
        self.leaves.append({"conv_id": conv_id, "node": self.path[-1][0]})

    def fits(self, turns, tree_chars: int, tree_leaves: int) -> bool:
        return bool(
            self.path and self.path[0][1:] == turns[0] and self.size < tree_chars and len(self.leaves) < tree_leaves
        )


def prefix_trees(
    conversations: DataFrame, loss_role: str = "assistant", tree_chars: int = 1 << 20, tree_leaves: int = 512
) -> DataFrame:
    """One row a tree: the emitted text, its nodes depth-first, and each conversation's last node."""
    empty = F.lit("")
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce(F.col("role"), empty).alias("role"),
        F.coalesce(F.col("text"), empty).alias("text"),
    )
    keyed = (
        rows.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
        .mapInArrow(_keyed, _KEYED)
    )
    keyed = stored(keyed, "chat-paths")
    order = ["path", "conv_id"]
    kind = T._parse_datatype_string(_TREE)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(kind)
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        tree = Tree()

        def row(t: Tree):
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(v, type=x.type)
                    for v, x in zip(([number], ["".join(t.text)], [t.nodes], [t.leaves]), schema, strict=True)
                ],
                schema=schema,
            )

        for b in sliced(batches, 64):
            for conv, roles, said in zip(*(b.column(n).to_pylist() for n in ("conv_id", "roles", "texts")), strict=True):
                turns = list(zip(roles, said, strict=True))
                if tree.leaves and not tree.fits(turns, tree_chars, tree_leaves):
                    yield row(tree)
                    tree, number = Tree(), number + 1
                tree.add(conv, turns, loss_role)
        if tree.leaves:
            yield row(tree)

    return (
        keyed.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("conv_id", "roles", "texts")
        .mapInArrow(build, kind)
    )


def read_back(trees: DataFrame) -> DataFrame:
    """Each conversation as read from its tree: its digests, loss text and formatted length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                text, nodes = r["text"], r["nodes"]
                parsed: list[tuple[bytes, str]] = []
                for x in nodes:
                    role, own = parse_turn(text[x["start"] : x["end"]])
                    loss = unescape(text[x["loss_start"] : x["loss_end"]])
                    parsed.append((f"{role}\n{own}\n".encode(), loss))
                out: dict[str, list] = {k: [] for k in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
                for leaf in r["leaves"]:
                    path, k = [], leaf["node"]
                    while k >= 0:
                        path.append(k)
                        k = nodes[k]["parent"]
                    turns, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
                    for k in reversed(path):
                        turns.update(parsed[k][0])
                        loss.update(parsed[k][1].encode())
                        chars += len(parsed[k][1])
                    last = nodes[leaf["node"]]
                    length = last["position"] + last["end"] - last["start"]
                    values = (leaf["conv_id"], len(path), turns.hexdigest(), chars, loss.hexdigest(), length)
                    for own, v in zip(out.values(), values, strict=True):
                        own.append(v)
                kinds = {"turns_sha256": pa.string(), "loss_sha256": pa.string()}
                yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], names=list(out))

    return trees.mapInArrow(
        run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
