"""Byte-level BPE with the tokenizers library.

The merges are derived once from a rank file and shipped to the tasks. Each text is cut
into the matches of the split pattern; a match is encoded by itself, so each task encodes
a match it has not seen before and looks the others up. Bytes map to characters by the
byte table of byte-level BPE; decoding reverses it. A token may hold part of a character:
its offsets then cover the whole character, and decoding joins bytes before characters.

Defined cases: null and empty texts have no tokens and decode to nothing; ids may be null or
repeat; a very long text is encoded in pieces, cut where a match must end, or whole if there is no such place;
extra columns are ignored, and those to keep must not have the result's names; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from tallylog.llm.batches import bounded_batches

#: Distinct matches a task remembers; the table starts anew when it is full.
CACHED = 400_000
#: Long texts are taken in pieces of about so many characters, cut where a match must end.
PIECE = 1 << 20
_CUT = re.compile("[0-9A-Za-z](?= [0-9A-Za-z])")


def byte_table() -> list[str]:
    """A printable character for each byte: itself if it is one, else one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def tokenizer_json(path: str) -> str:
    """The tokenizer of a rank file, as the library's JSON text.

    A token's merge is the pair that is left when its bytes are merged, lowest rank
    first, until two parts remain.
    """
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    table = byte_table()
    merges = []
    for token in sorted(ranks, key=ranks.get):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], len(ranks)))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            merges.append(tuple("".join(table[b] for b in part) for part in parts))
    vocabulary = {"".join(table[b] for b in token): rank for token, rank in ranks.items()}
    tokenizer = Tokenizer(models.BPE(vocab=vocabulary, merges=merges))
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return tokenizer.to_str()


@lru_cache(maxsize=2)
def _tokenizer(text: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_str(text)


def _pieces(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > 2 * PIECE:
        cut = _CUT.search(text, start + PIECE)
        if cut is None:
            break
        yield text[start : cut.end()]
        start = cut.end()
    yield text[start:]


class Encoder:
    """Encodes texts; remembers the ids and the character offsets of each match."""

    def __init__(self, tokenizer: str, pattern: str, offsets: bool = False):
        self.tokenizer, self.pattern, self.offsets = _tokenizer(tokenizer), regex.compile(pattern), offsets
        self.known: dict[str, bytes] = {}
        self.spans: dict[str, np.ndarray] = {}

    def _learn(self, matches: list[str]) -> None:
        new = list(set(matches).difference(self.known))
        if len(self.known) + len(new) > CACHED:
            self.known, self.spans, new = {}, {}, list(set(matches))
        encode = self.tokenizer.encode_batch if self.offsets else self.tokenizer.encode_batch_fast
        for match, encoding in zip(new, encode(new, add_special_tokens=False), strict=True):
            self.known[match] = np.array(encoding.ids, "<u4").tobytes()
            if self.offsets:
                self.spans[match] = np.array(encoding.offsets, np.int64).reshape(-1, 2)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray | None]:
        """Ids, and a row of start and end character for each if offsets are wanted."""
        ids, spans, start = [], [], 0
        for piece in _pieces(text):
            matches = self.pattern.findall(piece)
            try:
                found = [self.known[m] for m in matches]
            except KeyError:
                self._learn(matches)
                found = [self.known[m] for m in matches]
            ids += found
            if self.offsets:
                for match in matches:
                    spans.append(self.spans[match] + start)
                    start += len(match)
        found = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        return found, (np.concatenate(spans) if spans else np.empty((0, 2), np.int64)) if self.offsets else None


def _lists(rows: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(rows) if rows else np.empty(0), kind))


def encode(docs: DataFrame, path: str, pattern: str, offsets: bool = False, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_tokens, ids and ids_sha256 of each document.

    With ``offsets`` also the first character of each token and the one after its last
    (``starts``, ``ends``). ``path`` is the rank file, read here and shipped to the tasks.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shipped = spark.sparkContext.broadcast(tokenizer_json(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shipped.value, pattern, offsets)
        for batch in batches:
            done = [encoder.encode(text or "") for text in batch.column("_text").to_pylist()]
            ids = [x for x, _ in done]
            columns = [batch.column(name) for name in keep]
            columns += [
                pa.array(map(len, ids), pa.int64()),
                _lists(ids, pa.int32()),
                pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
            ]
            if offsets:
                columns += [_lists([x[:, k] for _, x in done], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *added])

    added = ["n_tokens", "ids", "ids_sha256"] + ["starts", "ends"] * offsets
    kinds = ["bigint", "array<int>", "string"] + ["array<bigint>"] * 2 * offsets
    kept = docs.select(*keep, F.col("text").alias("_text"))
    schema = [f"`{n}` {kept.schema[n].dataType.simpleString()}" for n in keep]
    return kept.mapInArrow(run, ", ".join(schema + [f"{n} {k}" for n, k in zip(added, kinds, strict=True)]))


class Decoder:
    """Ids back to bytes by the reversed byte table, and to text with whole characters."""

    def __init__(self, tokenizer: str):
        back = {c: b for b, c in enumerate(byte_table())}
        vocabulary = _tokenizer(tokenizer).get_vocab(with_added_tokens=False)
        self.tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            self.tokens[number] = bytes(back[c] for c in token)
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.lengths = np.array([len(token) for token in self.tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens in a row, some at a time."""
        return b"".join(self._gathered(ids[at : at + PIECE]) for at in range(0, len(ids), PIECE))

    def _gathered(self, ids: np.ndarray) -> bytes:
        """From the table of all tokens' bytes: the place of each byte in it, then the bytes."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        shifts = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.bytes[shifts + np.arange(len(shifts))].tobytes()


def decode(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the decoded bytes; their UTF-8 text is ``decode(decoded, 'UTF-8')``."""
    spark = encoded.sparkSession
    shipped: object = spark.sparkContext.broadcast(tokenizer_json(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shipped.value)
        for batch in batches:
            found = [decoder.decode(ids.values.to_numpy()) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(found, pa.binary())], [*keep, "decoded"])

    kept = encoded.select(*dict.fromkeys((*keep, "ids")))
    schema = [f"`{n}` {kept.schema[n].dataType.simpleString()}" for n in keep]
    return kept.mapInArrow(run, ", ".join([*schema, "decoded binary"]))
