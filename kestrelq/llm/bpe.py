"""Byte-level BPE encoding and decoding by batched merge rounds.

The symbols of many words lie in one flat numpy array. A round looks every neighbouring pair up by binary search in the sorted
array of merge keys, finds each word's lowest rank, merges all of that pair's occurrences from left to right and drops the
symbols that were consumed; words without a mergeable pair leave the array. Only words that a worker has not met are merged;
what it has met is kept in a bounded cache.

Defined results: a null text counts as empty; an empty text has no ids and decodes to the empty text; special tokens' strings in
a text are their ids; very long texts are encoded whole, long words outside the cache; rows are independent, so ties and repeated rows
give repeated results; an empty table gives an empty one; other columns pass through, but those named like the new ones are replaced.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrelq.llm.common import slices, table, trimmed

#: Fixed value: the pattern by which byte-level vocabularies of this family split texts (public_tokenizers.PATTERN).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHIFT = 20
NO_RANK = np.iinfo(np.int64).max
CACHE_WORDS, CACHE_CHARS = 150_000, 64
LONG_TEXT = 4_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the byte-level vocabularies: bytes that print stand for themselves, the others count up from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merge table and token bytes of a byte-level BPE file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model, alphabet = spec["model"], byte_alphabet()
        vocab: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([(vocab[a] << SHIFT) | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.of_byte = np.zeros(256, np.int64)
        for char, byte in alphabet.items():
            self.of_byte[byte] = vocab[char]
        size = max([*vocab.values(), *special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(alphabet[c] for c in token)
        for token, i in special.items():
            self.bytes_of[i] = token.encode()
        self.special = special
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pattern = regex.compile(PATTERN)
        self.cut = regex.compile(r"(?<=\p{L}) (?=\p{L})")
        self.cache: dict[str, bytes] = {}

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        out: list[bytes] = [b""] * len(words)
        while len(symbols):
            n = len(symbols)
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            rank, slot = np.full(n, NO_RANK), np.zeros(n, np.int64)
            key = (symbols[:-1] << SHIFT) | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = (self.keys[at] == key) & (owner[1:] == owner[:-1])
            rank[:-1][known] = self.ranks[at[known]]
            slot[:-1] = at
            lowest = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, n))
            done = lowest == NO_RANK
            if done.any():
                for begin, size in zip(first[done].tolist(), length[done].tolist(), strict=True):
                    out[owner[begin]] = symbols[begin : begin + size].astype("<u4").tobytes()
            chosen = (rank == np.repeat(lowest, length)) & (rank != NO_RANK)
            where = np.flatnonzero(chosen)
            if not len(where):
                break
            # of a run of overlapping occurrences every other one is merged, from the left
            head = np.concatenate(([True], np.diff(where) != 1))
            run = np.flatnonzero(head)
            where = where[(np.arange(len(where)) - np.repeat(run, np.diff(np.append(run, len(where))))) % 2 == 0]
            symbols[where] = self.made[slot[where]]
            keep = ~np.repeat(done, length)
            keep[where + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts; words are merged together for all of them."""
        return [b"".join(parts) for parts in self._parts(texts)]

    def _parts(self, texts: list[str]) -> list[list[bytes]]:
        pieces: list[list[list[str] | bytes]] = []
        unknown: set[str] = set()
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        for text in texts:
            own: list[list[str] | bytes] = []
            for span in self._spans(text):
                if isinstance(span, int):
                    own.append(span.to_bytes(4, "little"))
                else:
                    words = self.pattern.findall(span)
                    unknown.update(words)
                    own.append(words)
            pieces.append(own)
        unknown.difference_update(self.cache)
        todo = list(unknown)
        merged = dict(zip(todo, self.merge([w.encode() for w in todo]), strict=True)) if todo else {}
        self.cache.update((w, ids) for w, ids in merged.items() if len(w) <= CACHE_CHARS)
        lookup = self.cache if all(len(w) <= CACHE_CHARS for w in merged) else self.cache | merged
        return [[p if isinstance(p, bytes) else b"".join(map(lookup.__getitem__, p)) for p in own] for own in pieces]

    def _spans(self, text: str) -> Iterator[str | int]:
        """Ordinary text between special tokens, and these tokens' ids."""
        if self.special_pattern is None or not any(s in text for s in self.special):
            yield text
            return
        at = 0
        for m in self.special_pattern.finditer(text):
            if m.start() > at:
                yield text[at : m.start()]
            yield self.special[m[0]]
            at = m.end()
        if at < len(text):
            yield text[at:]

    def ids_of(self, text: str) -> Iterator[bytes]:
        """The ids of a very long text part by part; cut only at a space between two letters, where words end in any case."""
        at = 0
        while len(text) - at > LONG_TEXT:
            m = self.cut.search(text, at + LONG_TEXT)
            if not m:
                break
            yield from self.ids([text[at : m.start()]])
            at = m.start()
        yield from self.ids([text[at:]])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_texts(vocabulary: Vocabulary, texts: list[str | None]) -> list[bytes]:
    texts = [t or "" for t in texts]
    short = [t for t in texts if len(t) <= LONG_TEXT]
    found = iter(vocabulary.ids(short))
    return [next(found) if len(t) <= LONG_TEXT else b"".join(vocabulary.ids_of(t)) for t in texts]


_loaded: dict[int, Vocabulary] = {}


def _vocabulary(content) -> Vocabulary:
    """One vocabulary a worker; `content` is a broadcast of the file, some megabytes that do not grow with the data."""
    if content.id not in _loaded:
        _loaded.clear()
        _loaded[content.id] = Vocabulary(content.value)
    return _loaded[content.id]


class _Content:
    """A broadcast with the name under which a worker keeps what it made of it."""

    def __init__(self, spark: SparkSession, path: str):
        self.broadcast, self.id = spark.sparkContext.broadcast(Path(path).read_text(encoding="utf-8")), f"{path}-{spark.sparkContext.applicationId}"

    @property
    def value(self) -> str:
        return self.broadcast.value


def encode(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "token_ids", checked: str | None = None) -> DataFrame:
    """Adds `ids`, binary: the text's ids as little-endian unsigned 32-bit integers; and `checked`, if named: whether they decode to the text."""
    content = _Content(docs.sparkSession, path or default_vocabulary())
    made_here = {ids, checked}
    added = [T.StructField(ids, T.BinaryType())] + ([T.StructField(checked, T.BooleanType())] if checked else [])
    schema = T.StructType([f for f in docs.schema if f.name not in made_here] + added)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(content)
        for batch in slices(batches, text):
            columns = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in made_here]
            texts = batch.column(text).to_pylist()
            made = encode_texts(vocabulary, texts)
            columns.append(pa.array(made, pa.binary()))
            if checked:
                columns.append(pa.array([vocabulary.decode(x) == (t or "").encode() for x, t in zip(made, texts, strict=True)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.mapInArrow(trimmed(run), schema)


def decode(encoded: DataFrame, path: str | None = None, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """Adds `text`: what the ids stand for; bytes that are no UTF-8 become replacement characters."""
    content = _Content(encoded.sparkSession, path or default_vocabulary())
    schema = T.StructType([f for f in encoded.schema if f.name != text] + [T.StructField(text, T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(content)
        for batch in slices(batches, ids):
            columns = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != text]
            made = [vocabulary.decode(x or b"").decode("utf-8", "replace") for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([c for _, c in columns] + [pa.array(made, pa.string())], [n for n, _ in columns] + [text])

    return encoded.mapInArrow(trimmed(run), schema)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of the decoded text; encodes and decodes in one pass over the rows."""
    content = _Content(docs.sparkSession, path or default_vocabulary())
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(content)
        for batch in slices(batches, "text"):
            made = encode_texts(vocabulary, batch.column("text").to_pylist())
            texts = (vocabulary.decode(x).decode("utf-8", "replace") for x in made)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(x) // 4 for x in made], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in made], pa.string()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
