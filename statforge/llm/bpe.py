"""Byte-level BPE in linear time, by backtracking over longest matches.

An Aho-Corasick automaton over the vocabulary (bytes as Latin-1) gives the longest token at every
place. A sequence of tokens is what the merges give if each adjacent pair is compatible: undoing the
merges on both sides of the seam, no earlier merge may span it. Compatibility is memoised; where a
pair isn't compatible, the next shorter prefix is tried, and places from which there is no way on are
marked, so that each is left once. Pieces (matches of the split pattern) are memoised as well.
"""

from __future__ import annotations

import base64
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcodes as tc

#: Memoised pieces and pairs of a worker, before it starts anew.
MEMO = 1 << 18


#: Below this code point a split pattern is also compiled for re, with its \\p classes spelt out.
NARROW = 0x250
_WIDE = re.compile(f"[^\\x00-{chr(NARROW - 1)}]").search


def narrow_pattern(pattern: str):
    """findall for texts below NARROW: re is about twice as fast as regex, and each class is taken from regex."""
    every = "".join(map(chr, range(NARROW)))
    spelt = lambda m: "".join(map(re.escape, regex.findall(m[0], every)))
    try:
        compiled = re.compile(re.sub(r"\\[psSd](?:\{\w+\})?", lambda m: spelt(m) if _in_class(pattern, m.start()) else f"[{spelt(m)}]", pattern))
    except re.error:
        return None
    probes = [every, every[::-1], "".join(a + b for a in every for b in " a1.\n'" + chr(0xE9))]
    return compiled.findall if all(compiled.findall(x) == regex.findall(pattern, x) for x in probes) else None


def _in_class(pattern: str, at: int) -> bool:
    return pattern.rfind("[", 0, at) > pattern.rfind("]", 0, at)


class Encoder:
    """lines: the lines of a rank file, "base64(token) rank"."""

    def __init__(self, lines: list[bytes], pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.findall = regex.compile(pattern).findall
        self.narrow = narrow_pattern(pattern)
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.pieces: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int | None] = {}
        self.splits: dict[int, tuple[int, int] | None] = {}

    def prefix(self, rank: int) -> int | None:
        """The longest token that begins this one, itself excepted."""
        if rank not in self.shorter:
            token = self.tokens[rank]
            self.shorter[rank] = next((r for n in range(len(token) - 1, 0, -1) if (r := self.ranks.get(token[:n])) is not None), None)
        return self.shorter[rank]

    def split(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if rank not in self.splits:
            token, found = self.tokens[rank], None
            left = self.prefix(rank)
            while left is not None and found is None:
                right = self.ranks.get(token[len(self.tokens[left]) :])
                if right is not None and left < rank and right < rank and self.compatible(left, right, rank):
                    found = left, right
                left = self.prefix(left)
            self.splits[rank] = found
        return self.splits[rank]

    def compatible(self, left: int, right: int, limit: int | None = None) -> bool:
        """True if the merges leave a seam between these tokens; `limit`: only merges before that rank count."""
        key = (left, right)
        if limit is None and (known := self.pairs.get(key)) is not None:
            return known
        bound = float("inf") if limit is None else limit
        tokens, ranks, ok = self.tokens, self.ranks, True
        while True:
            joined = ranks.get(tokens[left] + tokens[right])
            if joined is not None and joined < bound:
                ok = False
                break
            # Undo the later of the two tokens' merges; what the seam could still join must come before it.
            for side in ((0, 1) if left > right else (1, 0)):
                parts = self.split(left if side == 0 else right)
                if parts:
                    break
            else:
                break
            if side == 0:
                bound, left = left, parts[1]
            else:
                bound, right = right + 1, parts[0]
        if limit is None:
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            self.pairs[key] = ok
        return ok

    def encode_bytes(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        longest, size = [-1] * n, [0] * n
        for end, (length, rank) in self.automaton.iter(data.decode("latin-1")):
            start = end - length + 1
            if length > size[start]:
                longest[start], size[start] = rank, length
        out: list[int] = []
        pos, rank, dead, tokens = 0, longest[0], bytearray(n + 1), self.tokens
        while pos < n:
            last = out[-1] if out else None
            while rank is not None:
                end = pos + len(tokens[rank])
                if not dead[end] and (last is None or self.compatible(last, rank)):
                    break
                rank = self.prefix(rank)
            if rank is None:
                dead[pos] = 1
                rank = out.pop()
                pos -= len(tokens[rank])
            else:
                out.append(rank)
                pos = end
                rank = longest[pos] if pos < n else None
        return out

    def encode(self, text: str) -> np.ndarray:
        out, memo = [], self.pieces
        for piece in self.narrow(text) if self.narrow and not _WIDE(text) else self.findall(text):
            got = memo.get(piece)
            if got is None:
                if len(memo) >= MEMO:
                    memo.clear()
                got = memo[piece] = np.array(self.encode_bytes(piece.encode()), "<u4").tobytes()
            out.append(got)
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


SCHEMA = "doc_id long, ids binary, decoded binary"


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text, and the bytes that they decode to.

    `ranks_path` is a rank file on the driver (a tokenizer's vocabulary, a few MB whatever the input);
    it is broadcast. Result: doc_id, ids (little-endian unsigned 32-bit integers in a row), decoded.
    Each match of `pattern` is encoded separately; no special tokens. A null or empty text has no ids.
    Repeated rows and rows with null ids are encoded like any other; an empty table gives no rows.
    Other columns are ignored.
    """
    with open(ranks_path, "rb") as f:
        lines = docs.sparkSession.sparkContext.broadcast(f.read())

    @tc.trimmed
    def encode(batches):
        enc = Encoder(lines.value.splitlines(), pattern)  # a task's own: no memo stays in a worker that goes on to other tasks
        for batch in batches:
            ids = [enc.encode(x.as_py() or "") for x in batch.column("text")]
            decoded = [enc.decode(x.tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, SCHEMA)


def public_ranks(spark: SparkSession) -> tuple[str, str]:
    """The rank file and the pattern that the registered queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
