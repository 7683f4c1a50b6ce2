"""Token counts: Arrow batches go to a tokenizer's batch encoder, and only lengths come back.

A text is cut at safe boundaries, places where no token, normalisation or special string of the tokenizer can
reach across; its count is the sum over its parts. Parts that a worker hasn't met are encoded in batches of
about BATCH_BYTES, whatever the sizes of the texts that they come from, and their lengths are memoised, so that
a very long text is a longer loop and never a larger batch.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcodes as tc

#: Bytes that one call of the encoder gets, and texts are taken in portions of.
BATCH_BYTES = 1 << 20
#: Parts with a known length that a worker keeps, twice: when so many are new, those not met since the last time go.
MEMO = 1 << 19
#: Longer parts are cut further and not memoised.
LONG = 4096

#: Whitespace is safe, and so is the end of a run of letters before a mark that no contraction or special string holds.
_PARTS = re.compile(r"[A-Za-z]+(?=[.,;:!?])|[^\x20\x09-\x0D]+")
_MARKS = ".,;:!?、。！，：；？"
#: Letters and digits that stay single letters and digits in lower case and under NFC, as not all do: ASCII, kana,
#: ideographs, Hangul.
_PLAIN = "0-9A-Za-z\u3041-\u3096\u30a1-\u30fa\u3400-\u9fff\uac00-\ud7a3"
#: Inside a long part: such a one beside a mark, and ASCII digits beside ASCII letters or digits.
_INSIDE = re.compile(rf"(?<=[{_PLAIN}])(?=[{_MARKS}])|(?<=[{_MARKS}])(?=[{_PLAIN}])|(?<=[0-9])(?=[0-9A-Za-z])|(?<=[A-Za-z])(?=[0-9])")
#: For sentence pieces: one space between letters or digits, which the next part's own prefix stands for.
_SPACE = re.compile(r"(?<=[^\W_]) (?=[^\W_])")


def _portions(text: str) -> Iterator[str]:
    """text in portions that end at white space, of about BATCH_BYTES characters."""
    at = 0
    while len(text) - at > BATCH_BYTES:
        cut = re.compile(r"[\x20\x09-\x0D]").search(text, at + BATCH_BYTES)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def _joined(pieces: list[str], sep: str, size: int) -> list[str]:
    """pieces put together again, while they stay within about size characters."""
    out, have, n = [], [], 0
    for p in pieces:
        if have and n + len(p) > size:
            out.append(sep.join(have))
            have, n = [], 0
        have.append(p)
        n += len(p)
    return [*out, sep.join(have)]


class WordCounter:
    """For a tokenizers file whose pre-tokenizer separates words, runs of letters, digits and marks."""

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks have the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(data)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def _encode(self, parts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def parts(self, text: str) -> Iterator[list[str]]:
        for portion in _portions(text):
            yield _PARTS.findall(portion)

    def _learn(self, new: list[str]) -> list[str]:
        """Encodes parts that aren't known; the long ones among them are given back, to be forgotten."""
        long = [p for p in new if len(p) > LONG]
        short = [p for p in new if len(p) <= LONG] if long else new
        self.known.update(zip(short, self._encode(short), strict=True))
        for p in long:
            self.known[p] = sum(self._encode(_joined(_INSIDE.split(p), "", LONG)))
        return long

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        out, known = [0] * len(texts), self.known
        waiting: list[tuple[int, list[str]]] = []
        new: dict[str, None] = {}
        size = 0

        def settle():
            nonlocal size
            long = self._learn(list(new))
            for i, parts in waiting:
                out[i] += sum(map(known.__getitem__, parts))
            for p in long:
                del known[p]
            if len(known) > MEMO:
                self.older = dict(known)
                known.clear()
            waiting.clear()
            new.clear()
            size = 0

        for i, text in enumerate(texts):
            for parts in self.parts(text):
                found = list(map(known.get, parts))
                missing = [p for p, n in zip(parts, found, strict=True) if n is None] if None in found else ()
                out[i] += sum(found) if not missing else sum(n for n in found if n is not None)
                rest = []
                for p in missing:
                    if (n := self.older.get(p)) is not None:
                        known[p] = n
                        out[i] += n
                        continue
                    rest.append(p)
                    if p not in new:
                        new[p] = None
                        size += len(p)
                if rest:
                    waiting.append((i, rest))
                if size >= BATCH_BYTES:
                    settle()
        settle()
        return out


class PieceCounter:
    """For a sentencepiece file. Texts are cut only where they are long, and only if no piece reaches across a space."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        prefixed = self.model.encode("a", out_type=str)[0].startswith("▁")
        self.safe = prefixed and not any("▁" in p.lstrip("▁") for p in pieces)

    def counts(self, texts: list[str]) -> list[int]:
        parts, owner = [], []
        for i, text in enumerate(texts):
            cut = _joined(_SPACE.split(text), " ", BATCH_BYTES) if self.safe and len(text) > BATCH_BYTES else [text]
            parts += cut
            owner += [i] * len(cut)
        out = [0] * len(texts)
        for i, ids in zip(owner, self.model.encode(parts, num_threads=1), strict=True):
            out[i] += len(ids)
        return out


_counters: dict[str, WordCounter | PieceCounter] = {}


def counter(data: bytes, kind: str) -> Callable[[list[str]], list[int]]:
    """A worker's counter for this tokenizer: built once in each process, for its next tasks as well."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _counters:
        _counters.clear()
        _counters[key] = WordCounter(data) if kind == ".json" else PieceCounter(data)
    return _counters[key].counts


def _balanced(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about BATCH_BYTES; a larger row is one of its own."""
    lo = n = 0
    for i, s in enumerate(sizes):
        if i > lo and n + s > BATCH_BYTES:
            yield lo, i
            lo, n = i, 0
        n += s
    if lo < len(sizes):
        yield lo, len(sizes)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every row.

    `tokenizer_path`: a file on the driver, of tokenizers (.json) or sentencepiece (.model), a few MB whatever the
    input, which is broadcast. A .json file's pre-tokenizer must drop white space and keep letters, digits and marks
    apart, or the parts would not add up; that is tried on the driver with a few strings (ValueError otherwise).
    Nothing is added, cut or padded. A null or empty text has no bytes and no tokens; repeated rows and null ids
    are counted like any other; an empty table gives no rows. Other columns are ignored.
    A text without any safe boundary (one run of letters) is encoded whole.
    """
    kind = os.path.splitext(tokenizer_path)[1]
    if kind not in (".json", ".model"):
        raise ValueError(f"neither .json nor .model: {tokenizer_path}")
    with open(tokenizer_path, "rb") as f:
        data = f.read()
    if kind == ".json":
        _try_boundaries(data)
    shared = docs.sparkSession.sparkContext.broadcast(data)

    @tc.trimmed
    def count(batches):
        counts = counter(shared.value, kind)
        for batch in batches:
            sizes, texts = batch.column("n_bytes").to_pylist(), batch.column("text")
            out: list[int] = []
            for lo, hi in _balanced(sizes):
                out += counts([x or "" for x in texts.slice(lo, hi - lo).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(out, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


#: Strings whose parts must add up to the whole.
PROBES = ("It's o'clock, they'll say: x.y,z!", "a1b22 c.d;e:f?g", "café. éå, 你好。世界，ab", "tab\tnew\nline  two", "<|endoftext|>a.<|startoftext|> b", "x" * 99 + "." + "9" * 40)


def _try_boundaries(data: bytes) -> None:
    mine = WordCounter(data)
    for text in PROBES:
        whole = mine._encode([text])[0]
        if mine.counts([text])[0] != whole or sum(mine._encode(_INSIDE.split(text))) != whole:
            raise ValueError(f"this tokenizer's tokens reach across white space or marks: {text!r}")


def public_words() -> str:
    """The tokenizer that the registered query counts by."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
