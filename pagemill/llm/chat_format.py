"""Chat formatting: conversations as training text, token ids and a loss mask over the tokens.

The template writes a turn as ``### role:``, a line feed, its text, a line feed and ``</turn>`` with a line
feed. Control strings inside roles and texts are escaped by backslashes, so formatted text reads back to the
same turns. A conversation is rendered whole and encoded once, with the characters of each token; the spans of
turns and those of tokens are both sorted, so a binary search finds the tokens under the loss.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .batches import short_batches
from .byte_bpe import codec

LEARNED = ("assistant",)
OPEN, CLOSE = "###", "\n</turn>\n"
# A conversation is cut, between turns, where the turn number passes a multiple of STRETCH or a part is full.
STRETCH = 4_096
PART_CHARS = 1 << 20
# Characters of finished parts that are encoded together.
TOGETHER = 1 << 18

_HEADER = re.compile(rf"{OPEN} ((?:[^\\:]|\\.)*):\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """Text without control strings: a backslash before each backslash, each ``#`` of ``###`` and before ``</turn>``."""
    return text.replace("\\", "\\\\").replace(OPEN, "\\#\\#\\#").replace("</turn>", "\\</turn>")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def header(role: str) -> str:
    return f"{OPEN} {escape(role).replace(':', chr(92) + ':')}:\n"


def render(turns: Iterable[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """Formatted text of (role, text) turns, and for each turn where its escaped text starts and ends."""
    pieces, spans, at = [], [], 0
    for role, text in turns:
        for piece in (header(role), escape(text), CLOSE):
            pieces.append(piece)
            at += len(piece)
        spans.append((at - len(CLOSE) - len(pieces[-2]), at - len(CLOSE)))
    return "".join(pieces), np.array(spans, dtype=np.int64).reshape(-1, 2)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of formatted text; ``render`` undone."""
    turns, at = [], 0
    while at < len(formatted):
        head = _HEADER.match(formatted, at)
        end = formatted.find(CLOSE, head.end()) if head else -1
        if end < 0:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescape(head[1]), unescape(formatted[head.end() : end])))
        at = end + len(CLOSE)
    return turns


def token_mask(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which tokens have characters in a span, and for those the first and the past-last such character.

    Tokens and spans are sorted. A token that only partly lies in a span counts, with its part; one that lies
    in two spans means that the pattern does not split at the template's marks, and is refused.
    """
    spans = spans[spans[:, 0] < spans[:, 1]]
    if not len(spans) or not len(starts):
        return np.zeros(len(starts), dtype=bool), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    first = np.searchsorted(spans[:, 1], starts, side="right")
    last = np.searchsorted(spans[:, 0], ends, side="left") - 1
    if (last > first).any():
        raise ValueError("a token reaches over two turns")
    under = last == first
    span = spans[first[under]]
    return under, np.maximum(starts[under], span[:, 0]), np.minimum(ends[under], span[:, 1])


def masked_text(formatted: str, low: np.ndarray, high: np.ndarray) -> str:
    """The characters that some stretches cover, each once: tokens that share a character cover it together."""
    if not len(low):
        return ""
    reached = np.maximum.accumulate(high)
    low = np.concatenate((low[:1], np.maximum(low[1:], reached[:-1])))
    breaks = np.flatnonzero(low[1:] != reached[:-1]) + 1
    runs = zip(low[np.concatenate(([0], breaks))].tolist(), reached[np.concatenate((breaks - 1, [len(low) - 1]))].tolist(), strict=True)
    return "".join([formatted[a:b] for a, b in runs])


def _stretch() -> Column:
    """The part of the turn numbers a row lies in; null turns come before all others."""
    return F.coalesce(F.floor(F.col("turn").cast("double") / STRETCH).cast("long"), F.lit(-(1 << 62)))


def _packed(values: np.ndarray) -> bytes:
    return values.astype("<u4").tobytes()


_SCHEMA = (
    "stretch long, part int, formatted string, turns array<struct<role:string,start:int,end:int>>, "
    "ids binary, starts binary, ends binary, mask binary, loss_starts binary, loss_ends binary"
)


def format_chats(conversations: DataFrame, rank_file: str, pattern: str, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """(conv_id, stretch, part, formatted, turns, ids, starts, ends, mask, loss_starts, loss_ends), conversations in order of turn.

    ``turns`` has each turn's role and the place of its escaped text in ``formatted``. ``ids``, ``starts`` and
    ``ends`` are the tokens and their characters as little-endian unsigned 32-bit integers, ``mask`` has a byte
    per token: 1 under the loss, the texts of roles in ``learned``. ``loss_starts`` and ``loss_ends`` give the
    characters under the loss of those tokens; they differ from the token's own where a token also holds a
    line feed of the template.

    Turns are sorted within tasks and stream through them, so a task holds one part at most: a conversation of
    very many turns is dealt out by stretches of STRETCH turn numbers, and one of very long texts is cut into
    parts between turns. Every turn ends with a line feed before ``###``, where the pattern always splits, so
    the parts' ids in a row are the ids of the whole. A null role or text is empty; null turns come first, equal
    turns by role and text, so repeated rows stay as turns; null conv_ids are one conversation. Other columns are
    left out; no rows give no rows.
    """
    short_batches(conversations.sparkSession)
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = conversations.select("conv_id", _stretch().alias("stretch"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", "turn", "role", "text")
    rows = rows.select("conv_id", "stretch", "role", "text")
    names = ["conv_id", *[f.split()[0] for f in re.sub(r"<.*>", "", _SCHEMA).split(", ")]]

    def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        """(key, part, turns) in order."""
        key, number, turns, chars = None, 0, [], 0
        for batch in batches:
            for conv, stretch, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                full = chars + len(text) > PART_CHARS
                if turns and (key != (conv, stretch) or full):
                    yield key, number, turns
                    number, turns, chars = (number + 1 if key == (conv, stretch) else 0), [], 0
                key = (conv, stretch)
                turns.append((role, text))
                chars += len(text)
        if turns:
            yield key, number, turns

    def encoded(held: list[tuple], ids_type: pa.DataType) -> pa.RecordBatch:
        tool = codec(rank_file, pattern)
        columns: list[list] = [[] for _ in names]
        for (key, number, roles, formatted, spans), ids in zip(held, tool.encode([h[3] for h in held]), strict=True):
            places = tool.offsets(formatted, ids)
            starts, ends = (np.frombuffer(p, dtype="<u4").astype(np.int64) for p in places)
            under, low, high = token_mask(starts, ends, spans[[r in learned for r in roles]])
            turns = [{"role": r, "start": a, "end": b} for r, (a, b) in zip(roles, spans.tolist(), strict=True)]
            row = (*key, number, formatted, turns, ids, *places, under.astype(np.uint8).tobytes(), _packed(low), _packed(high))
            for column, value in zip(columns, row, strict=True):
                column.append(value)
        span = pa.struct([("role", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        types = [ids_type, pa.int64(), pa.int32(), pa.string(), pa.list_(span), *[pa.binary()] * 6]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def noted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds[:] = [batch.schema.field(0).type]
                yield batch

        held, chars = [], 0
        for key, number, turns in parts(noted()):
            formatted, spans = render(turns)
            held.append((key, number, [r for r, _ in turns], formatted, spans))
            chars += len(formatted)
            if chars > TOGETHER:
                yield encoded(held, kinds[0])
                held, chars = [], 0
        if held:
            yield encoded(held, kinds[0])

    return rows.mapInArrow(run, f"conv_id {kind}, {_SCHEMA}")


def digests(parts: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from formatted parts.

    The turns are parsed from the formatted text; the loss text is what the masked tokens' characters cover,
    unescaped. The parts of a conversation must follow each other in order within a partition; they stream
    through its digests. A conversation without parts has no row.
    """
    kind = parts.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None
        for batch in batches:
            done = []
            for conv, formatted, low, high in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = parse(formatted)
                loss = unescape(masked_text(formatted, *[np.frombuffer(p, dtype="<u4").astype(np.int64) for p in (low, high)]))
                state[1] += len(turns)
                state[2].update("".join([f"{r}\n{t}\n" for r, t in turns]).encode("utf-8", "surrogatepass"))
                state[3] += len(loss)
                state[4].update(loss.encode("utf-8", "surrogatepass"))
                state[5] += len(formatted)
            if done:
                yield finished(done, batch.schema.field(0).type)
            last = batch.schema.field(0).type
        if state is not None:
            yield finished([state], last)

    def finished(states: list[list], ids_type: pa.DataType) -> pa.RecordBatch:
        rows = [(c, n, t.hexdigest(), k, s.hexdigest(), f) for c, n, t, k, s, f in states]
        types = [ids_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = [f.split()[0] for f in schema.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return parts.select("conv_id", "formatted", "loss_starts", "loss_ends").mapInArrow(run, schema)


def read_back(conversations: DataFrame, rank_file: str, pattern: str, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """``digests`` of all conversations as ``format_chats`` formats them; odd rows are taken as there.

    Conversations within the first STRETCH turn numbers are digested where they are formatted. The others are
    formatted by stretches in many tasks; their parts then stream through one task each, since a digest is
    sequential, with two digest states in memory.
    """
    conversations = conversations.select("conv_id", "turn", "role", "text")
    wide = broadcast_if_small(conversations.where(_stretch() != 0).select("conv_id").distinct().withColumnRenamed("conv_id", "wide"))
    same = F.col("conv_id").eqNullSafe(F.col("wide"))
    short = format_chats(conversations.join(wide, same, "left_anti"), rank_file, pattern, learned)
    long = format_chats(conversations.join(wide, same, "left_semi"), rank_file, pattern, learned)
    long = long.select("conv_id", "stretch", "part", "formatted", "loss_starts", "loss_ends")
    return digests(short).union(digests(long.repartition("conv_id").sortWithinPartitions("conv_id", "stretch", "part")))
