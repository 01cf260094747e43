"""Token ids as a binary corpus: Re-Pair grammar blocks with random access.

Documents are dealt into parts by ranges of doc_id (approximate quantiles of that column, as many as a setting says), each part is
sorted, and every part becomes blocks of about `BLOCK_IDS` ids that hold whole documents. Within a block frequent pairs of
neighbouring symbols are replaced by new symbols, the most frequent ones of a round at once, until no pair is left for which a rule saves
bytes; pairs never reach over the end of a document, so that each document is a slice of the block's symbols. A block stores its
documents, the rules, the lengths of what rules stand for, and the symbols; one document, or a range of its ids, is decoded without the rest.

Blocks are rows of a Parquet table in a shared folder. The global position of a block is the sum of all earlier parts (one
number a part reaches the driver) plus its position in its own part.

Defined results: a null or empty text has the end id alone; a very long text is a block of its own; a null doc_id comes first, then
ascending doc_id, equal doc_ids in the order of their ids; repeated rows are repeated; pairs that are equally frequent become rules in the
order of their ids; an empty table gives an empty one; other columns, also those named like its own, are left out.
"""

from __future__ import annotations

import json
import struct
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelq.llm.bpe import byte_alphabet
from kestrelq.llm.common import Workspace, partitions, slices, table, trimmed

#: Fixed value: the pattern by which the lower-casing word vocabulary splits texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A rule and its length take 12 bytes, a replaced pair saves two, so a pair must occur seven times to be worth a rule.
BLOCK_IDS, PAIRS_A_ROUND, FEW_PAIRS, LEAST_COUNT = 1 << 18, 2048, 600, 7
CACHE_WORDS, CACHE_CHARS = 900_000, 48
#: Signs that often end a word; an apostrophe, which can begin a piece of letters, is not among them.
TAILS = ".,;:!?*#$%&|)]}\"-"
SPREAD = 0x9E3779B97F4A7C15
MAGIC, HEAD = b"KQRP", struct.Struct("<4sIIIIIQ")
END_ID = 1


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Cache(dict):
    """Words met so far, up to a number; long ones are made each time."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, word: str) -> bytes:
        made = self.make(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = made
        return made


class WordEncoder:
    """Encodes as the tokenizers library does: its model merges the words, here kept in a bounded cache of what was met."""

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        spec = json.loads(content)
        self.tokenizer = Tokenizer.from_str(content)
        self.tokenize = self.tokenizer.model.tokenize
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*spec["model"]["vocab"].values(), *self.special.values()]) + 1
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"
        self.packed = [i.to_bytes(2 if self.kind == "<u2" else 4, "little") for i in range(self.size)]
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        self.pattern = regex.compile(PATTERN)
        self.char_of = {b: c for c, b in byte_alphabet().items()}
        self.cache, self.pieces = _Cache(self._word), _Cache(self._piece)
        self.assigned: set[str] = set()

    def _word(self, word: str) -> bytes:
        """Of a piece of lower-cased text without white space."""
        if word.isalpha():
            return self._piece(word)
        core = word.rstrip(TAILS)
        if core.isalpha():  # letters and one piece of signs
            return self.cache[core] + self.pieces[word[len(core) :]]
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(word)))

    def _piece(self, piece: str) -> bytes:
        # the bytes of letters of ASCII stand for themselves
        plain = piece if piece.isascii() and piece.isalpha() else "".join(map(self.char_of.__getitem__, piece.encode()))
        packed = self.packed
        return b"".join([packed[t.id] for t in self.tokenize(plain)])

    def _ordinary(self, text: str) -> bytes:
        if not text.isascii():
            new = set(text) - self.assigned
            if any(unicodedata.category(c) == "Cn" for c in new):
                # characters newer than Python's tables: the library's own tables differ from those of the pattern used here
                return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
            self.assigned |= new
            # lower-casing goes character by character, so that a final sigma is not told apart
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        # no piece of the pattern reaches over white space; these four are white space to split() alone
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self._word(text)
        return b"".join(map(self.cache.__getitem__, text.split()))

    def encode(self, text: str) -> bytes:
        if not any(s in text for s in self.special):
            return self._ordinary(text)
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            out += [self._ordinary(text[at : m.start()]), np.array([self.special[m[0]]], self.kind).tobytes()]
            at = m.end()
        return b"".join([*out, self._ordinary(text[at:])])


def _chosen(ranked: np.ndarray, half: int) -> np.ndarray:
    """Of sorted pairs: the most frequent ones, sorted, as many as a round takes, if a rule for them saves bytes; when they are few, such that no two overlap."""
    edge = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1], [True])))
    count = np.diff(edge)
    often = np.flatnonzero(count >= LEAST_COUNT)
    if len(often) > PAIRS_A_ROUND:
        often = often[np.argpartition(count[often], len(often) - PAIRS_A_ROUND)[-PAIRS_A_ROUND:]]
    pairs = ranked[edge[often]]
    if len(pairs) > FEW_PAIRS:
        return np.sort(pairs)
    left, right = (pairs >> pairs.dtype.type(half)).tolist(), (pairs & pairs.dtype.type((1 << half) - 1)).tolist()
    begins, ends, out = set(), set(), []
    # those of one symbol twice, which overlap themselves, come last
    for k in sorted(range(len(pairs)), key=lambda k: (left[k] == right[k], -count[often[k]], left[k], right[k])):
        if left[k] not in ends and right[k] not in begins:
            begins.add(left[k])
            ends.add(right[k])
            out.append(k)
    return np.sort(pairs[out])


def _places(key: np.ndarray, inner: np.ndarray | None, pairs: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that are replaced, at which places of key, and by which of them."""
    spread, drop = key.dtype.type(SPREAD >> (64 - 2 * half) | 1), key.dtype.type(2 * half - 16)
    # a table of hashes leads to the one pair that a place may hold; of pairs that meet there one waits for a later round
    slot, place = np.zeros(1 << 16, np.int32), (pairs * spread) >> drop
    slot[place] = np.arange(len(pairs), dtype=np.int32)
    alone = slot[place] == np.arange(len(pairs))
    pairs = pairs[alone]
    slot[place[alone]] = np.arange(len(pairs), dtype=np.int32)
    at = slot[(key * spread) >> drop]
    found = pairs[at] == key
    where = np.flatnonzero(found if inner is None else found & inner)
    return pairs, where, at[where]


def _apart(pairs: np.ndarray, where: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where chosen pairs overlap, every other one of a run is replaced, from the left; pairs of which too few are left wait."""
    run = np.flatnonzero(np.concatenate(([True], np.diff(where) != 1)))
    if len(run) < len(where):
        even = (np.arange(len(where)) - np.repeat(run, np.diff(np.append(run, len(where))))) % 2 == 0
        where, at = where[even], at[even]
    pays = np.bincount(at, minlength=len(pairs)) >= LEAST_COUNT
    if pays.all():
        return pairs, where, at
    keep, number = pays[at], np.cumsum(pays) - 1
    return pairs[pays], where[keep], number[at[keep]]


def compress(ids: np.ndarray, starts: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, each document's first symbol (and the end), and the rules; symbol base + k stands for rule k's pair.

    A round replaces the most frequent pairs. After one over all symbols come rounds over the pairs with a symbol of the round before, which
    are all of their kind; when these have no frequent pair left, all symbols are counted again, until they have none.
    """
    symbols, half = ids.astype(np.uint16 if base <= 1 << 16 else np.uint32), 16 if base <= 1 << 16 else 32
    last = np.zeros(len(symbols), bool)
    last[starts[1:] - 1] = True
    rules: list[np.ndarray] = []
    n_rules, spots = 0, None  # None: all
    while len(symbols) > 1:
        if half == 16 and base + n_rules + PAIRS_A_ROUND > 1 << 16:  # while all symbols fit into 16 bits, a pair is a 32-bit key
            symbols, half = symbols.astype(np.uint32), 32
        wide = np.uint32 if half == 16 else np.uint64
        inner = ~last[:-1] if spots is None else None
        key = ((symbols[:-1] if spots is None else symbols[spots]).astype(wide) << wide(half)) | (symbols[1:] if spots is None else symbols[spots + 1])
        ranked = np.sort(key if inner is None else key[inner])
        pairs = _chosen(ranked, half) if len(ranked) >= LEAST_COUNT else ranked[:0]
        where = at = None
        if len(pairs):
            pairs, where, at = _places(key, inner, pairs, half)
            where = where if spots is None else spots[where]
            pairs, where, at = _apart(pairs, where, at)
        if not len(pairs):
            if spots is None:
                break
            spots = None
            continue
        symbols[where] = base + n_rules + at
        last[where] = last[where + 1]
        keep = np.ones(len(symbols), bool)
        keep[where + 1] = False
        symbols, last = symbols[keep], last[keep]
        rules.append(np.stack([pairs >> wide(half), pairs & wide((1 << half) - 1)], axis=1).astype(np.uint32))
        n_rules += len(pairs)
        new = where - np.arange(len(where))
        beside = np.zeros(len(symbols) + 1, bool)
        beside[new] = beside[new - 1] = True  # before the first symbol: the spare place at the end
        spots = np.flatnonzero(beside[:-1] & ~last)
    first = np.concatenate(([0], np.flatnonzero(last) + 1))
    return symbols, first, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def expansions(rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all rules: the ids they stand for, one after another, and how many each has."""
    flat, owner = rules.reshape(-1).astype(np.int64), np.repeat(np.arange(len(rules)), 2)
    while len(flat) and (deep := flat >= base).any():
        size = np.where(deep, 2, 1)
        begin = np.cumsum(size) - size
        pair = rules[np.where(deep, flat - base, 0)]
        out = np.repeat(flat, size)
        out[begin[deep]], out[begin[deep] + 1] = pair[deep, 0], pair[deep, 1]
        flat, owner = out, np.repeat(owner, size)
    return flat.astype(np.uint32), np.bincount(owner, minlength=len(rules)).astype(np.uint32)


def write_block(doc_ids: list[int | None], ids: list[np.ndarray], base: int) -> bytes:
    """Head, documents (doc_id, whether null, first symbol, first id), rules, their lengths, symbols."""
    starts = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)
    symbols, first, rules = compress(np.concatenate(ids), starts, base)
    _, lengths = expansions(rules, base)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    parts = [
        HEAD.pack(MAGIC, 1, width, base, len(doc_ids), len(rules), len(symbols)),
        np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes(),
        np.array([x is None for x in doc_ids], "u1").tobytes(),
        first.astype("<u8").tobytes(),
        starts.astype("<u8").tobytes(),
        rules.astype("<u4").tobytes(),
        lengths.astype("<u4").tobytes(),
        symbols.astype(f"<u{width}").tobytes(),
    ]
    return b"".join(parts)


class Block:
    """Reads a block; `document` and `span` decode only what they are asked for."""

    def __init__(self, blob: bytes):
        magic, version, width, self.base, n, n_rules, n_symbols = HEAD.unpack_from(blob)
        if magic != MAGIC or version != 1:
            raise ValueError("no block of this format")
        at = HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, count, at)
            at += out.nbytes
            return out

        ids, null = take("<i8", n), take("u1", n)
        self.doc_ids = [None if x else i for i, x in zip(ids.tolist(), null.tolist(), strict=True)]
        self.first, self.starts = take("<u8", n + 1).astype(np.int64), take("<u8", n + 1).astype(np.int64)
        self.rules, self.lengths, self.symbols = take("<u4", 2 * n_rules).reshape(-1, 2), take("<u4", n_rules).astype(np.int64), take(f"<u{width}", n_symbols)
        # one table: plain ids stand for themselves, then what the rules stand for
        self.flat = np.concatenate((np.arange(self.base, dtype=np.uint32), expansions(self.rules, self.base)[0]))
        self.sizes = np.concatenate((np.ones(self.base, np.int64), self.lengths))
        self.begin = np.cumsum(self.sizes) - self.sizes

    def _sizes(self, symbols: np.ndarray) -> np.ndarray:
        return self.sizes[symbols]

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        size = self._sizes(symbols)
        shift = self.begin[symbols] - (np.cumsum(size) - size)
        return self.flat[np.repeat(shift, size) + np.arange(size.sum())]

    def all(self) -> np.ndarray:
        return self._expand(self.symbols)

    def document(self, k: int) -> np.ndarray:
        return self._expand(self.symbols[self.first[k] : self.first[k + 1]])

    def span(self, k: int, begin: int, end: int) -> np.ndarray:
        """Ids begin to end of document k, from the symbols that cover them."""
        symbols = self.symbols[self.first[k] : self.first[k + 1]]
        edge = np.concatenate(([0], np.cumsum(self._sizes(symbols))))
        a, b = np.searchsorted(edge, begin, "right") - 1, np.searchsorted(edge, end, "left")
        return self._expand(symbols[a:b])[begin - edge[a] : end - edge[a]]


_loaded: dict[str, WordEncoder] = {}


def encode(docs: DataFrame, bounds: list[int], path: str, end_id: int = END_ID) -> DataFrame:
    content, name = docs.sparkSession.sparkContext.broadcast(Path(path).read_text(encoding="utf-8")), f"{path}-{docs.sparkSession.sparkContext.applicationId}"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _loaded:
            _loaded.clear()
            _loaded[name] = WordEncoder(content.value)
        encoder = _loaded[name]
        end, edges = np.array([end_id], encoder.kind).tobytes(), np.array(bounds, np.int64)
        for batch in slices(batches, "text"):
            ids = batch.column("doc_id")
            part = np.searchsorted(edges, ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), "right")
            made = [encoder.encode(t or "") + end for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(part.astype(np.int32)), pa.array(made, pa.binary())], ["doc_id", "part", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), "doc_id long, part int, ids binary")


def pack(encoded: DataFrame, base: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks of rows that come sorted by part and doc_id."""
    kind = "<u2" if base <= 1 << 16 else "<u4"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sequence, begin, held, doc_ids, ids = None, 0, 0, 0, [], []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"part": part, "sequence": sequence, "begin": begin, "n_ids": held, "n_docs": len(doc_ids), "block": write_block(doc_ids, ids, base)}], schema)

        schema = pa.schema([("part", pa.int32()), ("sequence", pa.int32()), ("begin", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int32()), ("block", pa.binary())])
        for batch in batches:
            for d, p, x in zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), batch.column("ids"), strict=True):
                own = np.frombuffer(x.as_buffer(), kind)
                if doc_ids and (p != part or held + len(own) > block_ids):
                    yield flush()
                    sequence, begin, held, doc_ids, ids = sequence + 1, begin + held, 0, [], []
                if p != part:
                    part, sequence, begin = p, 0, 0
                doc_ids.append(d)
                ids.append(own.copy())
                held += len(own)
        if doc_ids:
            yield flush()

    return encoded.mapInArrow(trimmed(run), "part int, sequence int, begin long, n_ids long, n_docs int, block binary")


def write_corpus(docs: DataFrame, target: str, path: str | None = None, end_id: int = END_ID, parts: int | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Writes all documents' ids, each with the end id, as a table of blocks in ascending doc_id order."""
    spark, path = docs.sparkSession, path or default_vocabulary()
    parts = parts or 4 * partitions(spark)
    base = max(WordEncoder(Path(path).read_text(encoding="utf-8")).size, end_id + 1)
    cuts = [i / parts for i in range(1, parts)]
    bounds = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), cuts, 20 * parts)).first()[0] if cuts else []
    encoded = encode(docs, sorted({int(b) for b in bounds or []}), path, end_id)
    dealt = encoded.repartition(partitions(spark), "part").sortWithinPartitions("part", "doc_id", "ids")
    pack(dealt, base, block_ids).write.mode("overwrite").parquet(target)


def read_corpus(spark: SparkSession, source: str) -> DataFrame:
    """doc_id, start, and the ids of each document as little-endian unsigned 32-bit integers."""
    return _read(spark, source, "ids binary", pa.binary(), lambda ids: ids.astype("<u4").tobytes())


def read_digests(spark: SparkSession, source: str) -> DataFrame:
    return _read(spark, source, "ids_crc32 long", pa.int64(), lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))


def _read(spark: SparkSession, source: str, column: str, kind: pa.DataType, made_of) -> DataFrame:
    blocks = spark.read.schema("part int, sequence int, begin long, n_ids long, n_docs int, block binary").parquet(source)
    sums = sorted(map(tuple, blocks.groupBy("part").agg(F.sum("n_ids")).collect()))  # a row a part, however much data
    offset, total = {}, 0
    for part, n in sums:
        offset[part], total = total, total + n
    name = column.split()[0]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, begin, blob in zip(batch.column("part").to_pylist(), batch.column("begin").to_pylist(), batch.column("block"), strict=True):
                block = Block(blob.as_buffer().to_pybytes())
                ids, starts = block.all(), block.starts
                made = [made_of(ids[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(block.doc_ids, pa.int64()), pa.array(starts[:-1] + offset[part] + begin, pa.int64()), pa.array(np.diff(starts), pa.int64()), pa.array(made, kind)], ["doc_id", "start", "n_tokens", name])

    return blocks.select("part", "begin", "block").mapInArrow(trimmed(run), f"doc_id long, start long, n_tokens long, {column}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = f"{Workspace(spark, 'op7').path}/corpus"
    write_corpus(table(spark, sf_dir, "documents"), target)
    return read_digests(spark, target)
