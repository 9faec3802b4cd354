"""Chat formatting by assembling token sequences.

Every turn is encoded on its own: its text, in which control strings are
escaped, becomes ids of the vocabulary, and reserved ids, which no text can
produce, are spliced in for the control strings of the template.  A conversation
is the run of its turns.  Prefix sums over the lengths of the segments place the
text of learned turns in the sequence, and prefix sums over those places give the
loss mask.

Escaping puts one backslash behind the first character of a control string, and one
more where backslashes already stand there, so it can be undone and an escaped
text holds no control string.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webquarry.llm.common import ROW, text_of, with_row_id

#: Fixed value: how the rank files of byte-level vocabularies split a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


@dataclass(frozen=True)
class Template:
    """Control strings of a conversation: its begin, and an opener and a closer per role.

    Turns of other roles name their role between ``other[0]`` and ``other[1]`` and end with ``other[2]``.
    The text of ``learned`` roles is under the loss mask.
    """

    begin: str = "<s>"
    turns: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<|answer|>", "</s>")}
    )
    other: tuple[str, str, str] = ("<|role|>", "<|text|>", "<|end|>")
    learned: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        for a in self.controls:
            if len(a) < 2 or "\\" in a:
                raise ValueError(f"control strings have two characters or more and no backslash: {a!r}")
            for b in self.controls:
                if any(a[i:].startswith(b) or b.startswith(a[i:]) for i in range(1 if a == b else 0, len(a))):
                    raise ValueError(f"control strings may not overlap: {a!r}, {b!r}")

    @property
    def controls(self) -> list[str]:
        """All control strings; their place decides their id."""
        return [self.begin, *[c for pair in self.turns.values() for c in pair], *self.other]

    def pattern(self, slashes: str) -> re.Pattern[str]:
        return re.compile("|".join(re.escape(c[0]) + slashes + re.escape(c[1:]) for c in self.controls))

    def escape(self, text: str) -> str:
        return self.pattern(r"\\*").sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)

    def unescape(self, text: str) -> str:
        return self.pattern(r"\\+").sub(lambda m: m[0][0] + m[0][2:], text)


class Codec:
    """A byte-level vocabulary with reserved ids behind its own."""

    def __init__(self, ranks: bytes, template: Template):
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line)
        known = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.encoding = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=known, special_tokens={})
        self.template = template
        self.first = max(known.values()) + 1
        self.control = dict(zip(template.controls, range(self.first, self.first + len(template.controls)), strict=True))
        self.openers = {self.control[pair[0]]: role for role, pair in template.turns.items()}

    def text_ids(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(self.template.escape(text))

    def written(self, ids: np.ndarray) -> str:
        """What ids without reserved ones stand for, still escaped."""
        return self.encoding.decode_bytes(ids.tolist()).decode("utf-8", "surrogatepass")

    def turn_ids(self, role: str, text: str) -> tuple[list[int], int, int]:
        """The ids of a turn, how many stand before its text, and how many are its text."""
        name = self.template.other
        body = self.text_ids(text)
        if role in self.template.turns:
            opener, closer = self.template.turns[role]
            head = [self.control[opener]]
        else:
            closer = name[2]
            head = [self.control[name[0]], *self.text_ids(role), self.control[name[1]]]
        return [*head, *body, self.control[closer]], len(head), len(body)


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    """A rank file, read by the driver and sent along with the tasks (about a megabyte)."""
    with open(path, "rb") as file:
        return file.read()


def loss_mask(lengths: np.ndarray, heads: np.ndarray, texts: np.ndarray, learned: np.ndarray) -> np.ndarray:
    """1 for every token of a learned text: prefix sums place the segments, and prefix sums of their borders fill them."""
    starts = np.cumsum(lengths) - lengths + heads
    borders = np.zeros(int(lengths.sum()) + 1, np.int64)
    np.add.at(borders, starts, learned)
    np.subtract.at(borders, starts + texts, learned)
    return np.cumsum(borders)[:-1].astype(np.int8)


def encoded_turns(rows: DataFrame, codec_of, learned_roles: tuple[str, ...]) -> DataFrame:
    """``conv_id, turn``, the row id, ``ids, head, n_text, learned`` of every row; no shuffle."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of()
        for batch in batches:
            ids, heads, texts, learned = [], [], [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own, head, n = codec.turn_ids(role, text)
                ids.append(np.array(own, np.uint32).tobytes() if max(own) > 0xFFFF else np.array(own, np.uint16).tobytes())
                heads.append(head)
                texts.append(n)
                learned.append(role in learned_roles)
            keys = [batch.column(c) for c in ("conv_id", "turn", *ROW)]
            wide = [len(x) != 2 * n for x, n in zip(ids, (h + t + 1 for h, t in zip(heads, texts, strict=True)), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*keys, pa.array(ids, pa.binary()), pa.array(wide), pa.array(heads, pa.int32()), pa.array(texts, pa.int32()), pa.array(learned)],
                ["conv_id", "turn", *ROW, "ids", "wide", "head", "n_text", "learned"],
            )

    keys = "conv_id long, turn long, " + ", ".join(f"`{c}` long" for c in ROW)
    return rows.mapInArrow(encoded, keys + ", ids binary, wide boolean, head int, n_text int, learned boolean")


SCHEMA = "conv_id long, part int, n_turns int, ids array<int>, loss_mask array<byte>"


class Assembly:
    """The turns of one conversation that wait to be written, and the rows that wait to be sent."""

    def __init__(self, begin: int):
        self.begin = begin
        self.rows: list[tuple] = []
        self.held = 0
        self.start(None)

    def start(self, conv_id: int | None) -> None:
        self.conv_id, self.part = conv_id, 0
        self.turns: list[tuple[np.ndarray, int, int, bool]] = []
        self.tokens = 0

    def add(self, ids: np.ndarray, head: int, n_text: int, learned: bool) -> None:
        if not self.part and not self.turns:
            # The begin of the conversation stands before its first turn.
            ids, head = np.concatenate([[self.begin], ids]), head + 1
        self.turns.append((ids, head, n_text, learned))
        self.tokens += len(ids)

    def cut(self) -> None:
        """Write the waiting turns as the next row of the conversation."""
        if self.turns:
            ids, heads, texts, learned = zip(*self.turns, strict=True)
            lengths = np.array([len(x) for x in ids])
            mask = loss_mask(lengths, np.array(heads), np.array(texts), np.array(learned, np.int64))
            self.rows.append((self.conv_id, self.part, len(ids), np.concatenate(ids).astype(np.int32), mask))
            self.held += len(mask)
            self.part += 1
            self.turns, self.tokens = [], 0

    def batch(self) -> pa.RecordBatch:
        ends = np.cumsum([0, *[len(r[3]) for r in self.rows]]).astype(np.int32)
        columns = [
            pa.array([r[0] for r in self.rows], pa.int64()),
            pa.array([r[1] for r in self.rows], pa.int32()),
            pa.array([r[2] for r in self.rows], pa.int32()),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([r[3] for r in self.rows]))),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([r[4] for r in self.rows]))),
        ]
        self.rows, self.held = [], 0
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "part", "n_turns", "ids", "loss_mask"])


def format_conversations(
    conversations: DataFrame,
    vocabulary: bytes,
    template: Template | None = None,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    row_tokens: int = 1 << 16,
) -> DataFrame:
    """Token sequences ``conv_id, part, n_turns, ids, loss_mask``, the parts of a conversation together and in order.

    Turns come in the order of ``turn_col``, null last; those that share a number keep the order of
    their rows, repeated rows are turns of their own.  Null texts and roles count as empty; rows without a conversation id form one
    conversation.  A conversation of more than ``row_tokens`` tokens is cut between turns into
    several parts, so one that holds a third of all rows streams through its task in bounded
    memory; a single very long text is encoded whole.  An empty table gives an empty result; other columns are not read.
    """
    template = template or Template()
    rows = with_row_id(conversations).select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        text_of(role_col).alias("role"),
        text_of(text_col).alias("text"),
        *ROW,
    )
    turns = encoded_turns(rows, lambda: Codec(vocabulary, template), template.learned)
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), *ROW)

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        build, begun = Assembly(Codec(vocabulary, template).control[template.begin]), False
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "ids", "wide", "head", "n_text", "learned")]
            for conv_id, ids, wide, head, n_text, learned in zip(*columns, strict=True):
                if not begun or conv_id != build.conv_id:
                    build.cut()
                    build.start(conv_id)
                    begun = True
                build.add(np.frombuffer(ids, np.uint32 if wide else np.uint16), head, n_text, learned)
                if build.tokens >= row_tokens:
                    build.cut()
                if build.held >= row_tokens:
                    yield build.batch()
        build.cut()
        if build.rows:
            yield build.batch()

    return ordered.select("conv_id", "ids", "wide", "head", "n_text", "learned").mapInArrow(assembled, SCHEMA)


def in_order(formatted: DataFrame) -> DataFrame:
    """Formatted rows that come from files: the parts of a conversation together and in order."""
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")


class Reader:
    """What the token sequences of one conversation say, read part by part."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def read(self, ids: np.ndarray, mask: np.ndarray) -> None:
        codec, template = self.codec, self.codec.template
        names = template.controls
        marks = np.flatnonzero(ids >= codec.first)
        role_mark, text_mark = codec.control[template.other[0]], codec.control[template.other[1]]
        role = ""
        for at, after in zip(marks, [*marks[1:], len(ids)], strict=True):
            mark = int(ids[at])
            body = codec.written(ids[at + 1 : after])
            self.formatted_chars += len(names[mark - codec.first]) + len(body)
            if mark == role_mark:
                role = template.unescape(body)
            elif mark == text_mark or mark in codec.openers:
                name = codec.openers.get(mark, role)
                self.n_turns += 1
                self.turns.update(f"{name}\n{template.unescape(body)}\n".encode("utf-8", "surrogatepass"))
        edges = np.flatnonzero(np.diff(mask, prepend=0, append=0))
        for start, end in zip(edges[::2], edges[1::2], strict=True):
            text = template.unescape(codec.written(ids[start:end]))
            self.loss_chars += len(text)
            self.loss.update(text.encode("utf-8", "surrogatepass"))

    def row(self, conv_id: int | None) -> tuple:
        return conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


def read_back(formatted: DataFrame, vocabulary: bytes, template: Template | None = None) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` of every conversation, from ids and masks alone.

    The rows must lie as ``format_conversations`` returns them or ``in_order`` puts them.  The digests
    run over the parts of a conversation one after the other, so no conversation is held whole.
    """
    template = template or Template()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary, template)
        reader, current, out = None, None, []
        for batch in batches:
            ids, masks = batch.column("ids"), batch.column("loss_mask")
            for i, (conv_id, part) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("part").to_pylist(), strict=True)):
                if part == 0:
                    if reader:
                        out.append(reader.row(current))
                    reader, current = Reader(codec), conv_id
                reader.read(np.asarray(ids[i].values), np.asarray(masks[i].values))
            if out:
                yield pa.RecordBatch.from_pydict({n: list(c) for n, c in zip(names, zip(*out, strict=True), strict=True)}, schema=kinds)
                out = []
        if reader:
            out = [reader.row(current)]
            yield pa.RecordBatch.from_pydict({n: list(c) for n, c in zip(names, zip(*out, strict=True), strict=True)}, schema=kinds)

    kinds = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], strict=True)))
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "part", "ids", "loss_mask").mapInArrow(said, schema)
