"""Chat formatting by tokens: segments are encoded apart, reserved ids are spliced between them, masks come from prefix sums.

A conversation is `<s>`, then its turns: `[SYS]`text`[/SYS]`, `[INST]`text`[/INST]`, and for an assistant text`</s>`; any
other role is spelled out, `[ROLE]`role`[/ROLE]`text`</s>`. Each of these marks is one reserved id above the vocabulary, and
no text can give one: a text is encoded as ordinary text, and where it spells a mark, a backslash after the mark's first
character is put in (one more than are there, so that reading back takes one out and restores every text).

Null texts and roles count as empty, null turns come first, and rows that tie on turn are put in order by role and text.
Null conv_id is a conversation of its own. An empty table gives an empty result; other columns are left out.

Turns are encoded where they lie, before the shuffle, so that a conversation with many turns is not one task's work to
encode. It is then put together as a stream, in parts of a bounded number of tokens.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, strings

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MARKS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]")
BEGIN, END, USER, USER_END, SYSTEM, SYSTEM_END, ROLE, ROLE_END = range(8)
#: Tokens of a part at least, unless it is the last; a turn is never cut.
PART_TOKENS = 1 << 18

_SPELLED = re.compile("|".join(f"({re.escape(m[0])})(\\\\*)({re.escape(m[1:])})" for m in MARKS))


_ENDINGS = ("s>", "INST]", "SYS]", "ROLE]")  # every mark ends with one of these


def escape(text: str) -> str:
    return _SPELLED.sub(lambda m: m[0][0] + "\\" + m[0][1:], text) if any(e in text for e in _ENDINGS) else text


def unescape(text: str) -> str:
    return _SPELLED.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text) if any(e in text for e in _ENDINGS) else text


class Codec:
    """A byte-level BPE vocabulary with the marks' ids above it."""

    def __init__(self, file: bytes):
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines())}
        self.encoding = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.first = max(ranks.values()) + 1

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(self.encoding.encode_ordinary(t), np.int32) for t in texts]

    def decode(self, ids: np.ndarray) -> str:
        return self.encoding.decode_bytes(ids.tolist()).decode("utf-8")


@lru_cache(maxsize=2)
def _codec(file: bytes) -> Codec:
    return Codec(file)


def turn_segments(role: str, text: np.ndarray, name: np.ndarray, first: int) -> list[tuple[np.ndarray, bool]]:
    """A turn's segments of ids, each with whether the loss is on it."""
    mark = lambda k: (np.array([first + k], np.int32), False)
    if role == "assistant":
        return [(text, True), mark(END)]
    if role == "user":
        return [mark(USER), (text, False), mark(USER_END)]
    if role == "system":
        return [mark(SYSTEM), (text, False), mark(SYSTEM_END)]
    return [mark(ROLE), (name, False), mark(ROLE_END), (text, False), mark(END)]


def splice(segments: list[tuple[np.ndarray, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask: each masked segment is +1 at its start and -1 at its end, and the mask their running sum."""
    ends = np.cumsum([len(ids) for ids, _ in segments])
    step = np.zeros(int(ends[-1]) + 1, np.int8)
    for (ids, on), end in zip(segments, ends, strict=True):
        if on:
            step[end - len(ids)] += 1
            step[end] -= 1
    return np.concatenate([ids for ids, _ in segments]), np.cumsum(step[:-1], dtype=np.int8)


def format_conversations(df: DataFrame, tokenizer: str = TOKENIZER, part_tokens: int = PART_TOKENS) -> DataFrame:
    """(conv_id, part, input_ids, loss_mask): a conversation's parts in order, side by side in one partition."""
    file = df.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())
    small_batches(df.sparkSession)
    kind = df.schema["conv_id"].dataType.simpleString()
    turn = df.schema["turn"].dataType.simpleString()
    encoded = df.select("conv_id", "turn", "role", "text").mapInArrow(_encoder(file), f"conv_id {kind}, turn {turn}, role string, name binary, ids binary, text string")
    together = encoded.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text").drop("text")
    return together.mapInArrow(_assembler(file, part_tokens), f"conv_id {kind}, part long, input_ids array<int>, loss_mask array<tinyint>")


def _encoder(file: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(file.value)
        for b in batches:
            roles, texts = strings(b.column(2)), strings(b.column(3))
            odd = codec.encode([escape(r) if r not in ("user", "assistant", "system") else "" for r in roles])
            ids = codec.encode([escape(t) for t in texts])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(roles, pa.string()), pa.array([x.tobytes() for x in odd], pa.binary()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(texts, pa.string())],
                ["conv_id", "turn", "role", "name", "ids", "text"],
            )

    return run


def _assembler(file: Broadcast, part_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = _codec(file.value).first
        open_, key, part, segments, tokens = False, None, 0, [], 0

        def flush(kind: pa.DataType) -> pa.RecordBatch:
            ids, mask = splice(segments)
            return pa.RecordBatch.from_arrays(
                [pa.array([key], kind), pa.array([part], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids)), pa.ListArray.from_arrays(pa.array([0, len(mask)], pa.int32()), pa.array(mask))],
                ["conv_id", "part", "input_ids", "loss_mask"],
            )

        kind = pa.int64()
        done: list[pa.RecordBatch] = []
        for b in batches:
            kind = b.schema.field(0).type
            for conv, role, name, ids in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if not open_ or conv != key:
                    if open_:
                        done.append(flush(kind))
                    open_, key, part, tokens = True, conv, 0, 0
                    segments = [(np.array([first + BEGIN], np.int32), False)]
                elif tokens >= part_tokens:
                    done.append(flush(kind))
                    part, tokens, segments = part + 1, 0, []
                more = turn_segments(role, np.frombuffer(ids, np.int32), np.frombuffer(name, np.int32), first)
                segments += more
                tokens += sum(len(x) for x, _ in more)
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
                done = []
        if open_:
            yield flush(kind)

    return run


class _Reader:
    """What has been read back of one conversation."""

    def __init__(self, key):
        self.key, self.turns, self.loss_chars, self.chars = key, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def take(self, ids: np.ndarray, mask: np.ndarray, codec: Codec) -> None:
        def text(a: int, b: int) -> str:
            found = codec.decode(ids[a:b])
            self.chars += len(found)
            return unescape(found)

        at = 0
        marks = np.flatnonzero(ids >= codec.first)
        kinds = (ids[marks] - codec.first).tolist()
        self.chars += sum(len(MARKS[k]) for k in kinds)
        role = None
        for where, k in zip(marks.tolist(), kinds, strict=True):
            if k in (END, USER_END, SYSTEM_END):
                said = text(at, where)
                who = {USER_END: "user", SYSTEM_END: "system"}.get(k, "assistant" if role is None else role)
                self.turns += 1
                self.all.update(f"{who}\n{said}\n".encode())
                role = None
            elif k == ROLE_END:
                role = text(at, where)
            at = where + 1
        edges = np.flatnonzero(np.diff(np.concatenate(([0], mask, [0]))))
        for a, b in edges.reshape(-1, 2).tolist():
            said = unescape(codec.decode(ids[a:b]))
            self.loss_chars += len(said)
            self.loss.update(said.encode())

    def row(self) -> tuple:
        return self.key, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """A row a conversation: turns, texts and loss texts as decoded from the ids and masks of format_conversations()."""
    file = formatted.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, now, key = _codec(file.value), None, pa.int64()
        types = lambda: [key, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types(), strict=True)], names)
        for b in batches:
            key, rows = b.schema.field(0).type, []
            for i, (conv, part) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if part == 0:
                    rows += [now.row()] if now else []
                    now = _Reader(conv)
                now.take(b.column(2)[i].values.to_numpy(), b.column(3)[i].values.to_numpy(), codec)
            if rows:
                yield pack(rows)
        if now:
            yield pack([now.row()])

    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
