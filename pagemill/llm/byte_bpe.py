"""Byte-level BPE: encoding to ids with character offsets, and decoding back to bytes.

The merges run in the tokenizers library, once for each different piece of an Arrow batch. A piece is
shown to it byte by byte, each byte as one printable character; ids come back as little-endian unsigned
32-bit integers in a binary column, which is the form the digests and files want.
"""

from __future__ import annotations

import base64
import functools
import unicodedata
from array import array
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import map_texts

# Different words, and different pieces, a worker remembers before it starts anew.
REMEMBERED = 75_000


def byte_alphabet() -> list[str]:
    """One printable character for each byte: itself where it is printable, else one above 255."""
    shown = {b for b in range(256) if 33 <= b <= 126 or (b >= 161 and b != 173)}
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class Codec:
    """The tokenizer of one rank file, as the pieces of one pattern are encoded with it."""

    def __init__(self, rank_file: str, pattern: str) -> None:
        import regex
        from tokenizers import Tokenizer, models

        with open(rank_file, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.pattern = pattern
        self.split = regex.compile(pattern).findall
        alphabet = byte_alphabet()
        self.shown = dict(enumerate(alphabet))
        self.token_bytes: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        merges = []
        for token, rank in sorted(self.ranks.items(), key=lambda item: item[1]):
            self.token_bytes[rank] = token
            # Any two tokens whose bytes make this one may merge, at its rank.
            cuts = ((token[:i], token[i:]) for i in range(1, len(token)))
            merges += [(self.show(a), self.show(b)) for a, b in cuts if a in self.ranks and b in self.ranks]
        self.token_sizes = np.array([len(t) for t in self.token_bytes], dtype=np.int64)
        vocab = {self.show(token): rank for token, rank in self.ranks.items()}
        self.model = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True, cache_capacity=0))
        self.cache: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.unsettled = _unsettled(regex)
        self.whole = None

    def show(self, data: bytes) -> str:
        return data.decode("latin-1").translate(self.shown)

    def encode(self, values: list[str]) -> list[bytes]:
        """Ids of each text as packed 32-bit integers.

        A blank between two other characters always starts a match, so texts are cut there first: what
        lies between two such blanks is looked up whole, and split by the pattern only when it is new.
        """
        if len(self.words) > REMEMBERED:
            self.words.clear()
        words = [None if self._is_unsettled(v) else v.split(" ") for v in values]
        self._learn(set(chain.from_iterable(row[1:] for row in words if row)) - self.words.keys())
        firsts = self._encode_pieces([self.split(row[0]) if row else [] for row in words])
        out = []
        for value, row, first in zip(values, words, firsts, strict=True):
            if row is None:
                out.append(self._encode_whole(value))
            elif row[0][-1:].isspace() or not self.words.keys() >= set(row[1:]):
                out += self._encode_pieces([self.split(value)])
            else:
                out.append(first + b"".join(map(self.words.__getitem__, row[1:])))
        return out

    def _learn(self, words: set[str]) -> None:
        """Remember the ids of words as they are after a blank; other white space at an end keeps a word out."""
        ordered = [w for w in words if w and not w[0].isspace() and not w[-1].isspace()]
        if not ordered:
            return
        pieces = self.split(" " + " ".join(ordered))  # each blank here starts a piece
        starts = [i for i, piece in enumerate(pieces) if piece[0] == " "]
        found = self._ids_of(pieces)
        sizes = np.cumsum([0, *map(len, found)])
        cuts = sizes[[*starts, len(pieces)]].tolist()
        blob = b"".join(found)
        self.words.update(zip(ordered, [blob[a:b] for a, b in pairwise(cuts)], strict=True))

    def _encode_pieces(self, rows: list[list[str]]) -> list[bytes]:
        found = iter(self._ids_of([p for row in rows for p in row]))
        return [b"".join(islice(found, len(row))) for row in rows]

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        if len(self.cache) > REMEMBERED:
            self.cache.clear()
        new = list(set(pieces) - self.cache.keys())
        shown = [self.show(p.encode("utf-8", "surrogatepass")) for p in new]
        for piece, found in zip(new, self.model.encode_batch_fast(shown, add_special_tokens=False) if new else [], strict=True):
            self.cache[piece] = array("I", found.ids).tobytes()
        return list(map(self.cache.__getitem__, pieces))

    def _is_unsettled(self, value: str) -> bool:
        return not value.isascii() and bool(self.unsettled[np.frombuffer(value.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].any())

    def _encode_whole(self, value: str) -> bytes:
        """Texts with characters that Unicode versions class differently: the other library decides."""
        import tiktoken

        if self.whole is None:
            self.whole = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
        return np.array(self.whole.encode_ordinary(value), dtype="<u4").tobytes()

    def offsets(self, value: str, ids: bytes) -> tuple[bytes, bytes]:
        """First character of each token and the one after its last, both packed as the ids are.

        A token that holds only some bytes of a character covers that whole character.
        """
        data = np.frombuffer(value.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        ends = np.cumsum(self.token_sizes[np.frombuffer(ids, dtype="<u4")])
        if not len(ends):
            return b"", b""
        character = np.cumsum((data & 0xC0) != 0x80) - 1
        starts = np.concatenate(([0], ends[:-1]))
        return character[starts].astype("<u4").tobytes(), (character[ends - 1] + 1).astype("<u4").tobytes()


def _unsettled(regex) -> np.ndarray:
    """For each code point: unassigned in Python's own tables but classed by the regex library."""
    classed = regex.compile(r"[\p{L}\p{N}\s]")
    return np.array([unicodedata.category(chr(c)) == "Cn" and bool(classed.match(chr(c))) for c in range(0x110000)])


@functools.lru_cache(maxsize=2)
def token_table(rank_file: str) -> list[bytes]:
    """The bytes of each id; all that decoding needs."""
    with open(rank_file, "rb") as lines:
        found = {int(b): base64.b64decode(a) for a, b in (line.split() for line in lines if line.strip())}
    return [found.get(i, b"") for i in range(max(found) + 1)]


def decoded(ids: bytes, table: list[bytes]) -> bytes:
    """Bytes of all tokens in a row; characters split between tokens close up again."""
    return b"".join([table[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


@functools.lru_cache(maxsize=2)
def codec(rank_file: str, pattern: str) -> Codec:
    return Codec(rank_file, pattern)


def encode(docs: DataFrame, rank_file: str, pattern: str, keep: list[str] | None = None, with_offsets: bool = False, with_decoded: bool = False) -> DataFrame:
    """Add ``ids`` (binary, little-endian unsigned 32-bit) to the kept columns of ``docs``.

    Each match of ``pattern`` is encoded separately, without special tokens. Null and empty texts have
    empty ids. ``with_offsets`` adds ``starts`` and ``ends``: each token's characters in the text.
    ``with_decoded`` adds ``decoded``, what ``decode`` makes of the ids, in the same Python worker.
    ``docs`` may have any other columns; those not in ``keep`` (default: ``doc_id``) are left out.
    Rows are independent, so repeated rows, ties and null keys stay as they are.
    """
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

    def work(_: pa.RecordBatch, values: list[str]) -> dict:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tool = codec(rank_file, pattern)
        ids = tool.encode(values)
        out = {"ids": pa.array(ids, pa.binary())}
        if with_offsets:
            spans = [tool.offsets(v, i) for v, i in zip(values, ids, strict=True)]
            out |= {"starts": pa.array([s for s, _ in spans], pa.binary()), "ends": pa.array([e for _, e in spans], pa.binary())}
        if with_decoded:
            out["decoded"] = pa.array([decoded(i, tool.token_bytes) for i in ids], pa.binary())
        return out

    schema = "ids binary" + (", starts binary, ends binary" if with_offsets else "") + (", decoded binary" if with_decoded else "")
    return map_texts(docs, work, schema, keep or ["doc_id"])


def decode(tokens: DataFrame, rank_file: str) -> DataFrame:
    """Add ``decoded`` (binary), the bytes of ``ids``, to all columns of ``tokens``. Null ids decode to nothing."""
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields)
    at = tokens.columns.index("ids")

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                table = token_table(rank_file)
                done = pa.array([decoded(i or b"", table) for i in batch.column(at).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, done], names=[*batch.schema.names, "decoded"])

    return tokens.mapInArrow(run, f"{out}, decoded binary")
