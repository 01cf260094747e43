"""Substring deduplication with a log-structured index of window hashes.

A window is `WINDOW` consecutive words of one document. It is removed if its word sequence also starts earlier: in a document with a
smaller doc_id, or earlier in the same document. The index holds sorted immutable runs of the window hashes of all earlier batches. A
batch, whose doc_ids are larger than those before it, is merge-joined with the runs, bucket by bucket of the hash; what is new becomes
a run of its own. A batch that is as large as the last run or larger is compacted with it in the same pass, so runs grow in size
towards the oldest and are few. A manifest in the index's folder names the runs, so that an index can be opened again later.

A window's fingerprint is a 64-bit multilinear hash of its words' hashes; a second, independent 24-bit hash verifies each match (of 2e13
windows, about 100 TB of text, less than one pair of different ones is expected to agree on both). Hashes of many windows travel as
packed columns, one row for each bucket and slice of texts. A slice sends each different window once, and a task does not send again
what it has found to be frequent, so a passage that a third of all documents share costs a row's share for each task.

Buckets are as many as leave each about `BUCKET_WINDOWS` windows of a batch, so that a worker's memory does not grow with the input.

Defined results: a null or empty text has no words; documents of fewer words than a window lose none; very long texts are one document
like any other; a null doc_id counts as before all others; rows that share a doc_id are one document as to what is earlier, and among
them windows at one place are equally early; repeated rows get repeated results; an empty table gives an empty one; other columns pass
through in `deduplicate`, also those named like its own, but for n_removed, which is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrelq.llm.common import WordHashes, Workspace, factors, partitions, release, slices, table, trimmed

#: Batches of a corpus: BATCHES, or more so that each has at most BATCH_BYTES of text.
WINDOW, BATCHES, BATCH_BYTES = 20, 4, 1 << 42
#: Windows of a batch in a bucket and marks in a group of documents, about; bytes of text for each window, about.
BUCKET_WINDOWS, GROUP_MARKS, BYTES_A_WINDOW = 1 << 17, 1 << 18, 6
SLICE, PAYLOAD, MARKS_AT_ONCE, FREQUENT, BROADCAST_ROWS = 1_000_000, 2_000_000, 250_000, 1 << 17, 200_000
CACHE_WORDS = 150_000
FIRST = np.iinfo(np.int64).min
CHECK = np.uint64(40)
#: Columns of its own, named so that they clash with none of the input's.
KEY, SPANS = "__kestrelq_key", "__kestrelq_spans"
EVENT = "bucket int, kind int, payload binary"


def _windows(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and check of the window that begins at each word, as if all words were one text."""
    by = factors(window, 2)
    n = len(hashes) - window + 1
    main, check = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for j in range(window):
        main += hashes[j : j + n] * by[0, j]
        check += hashes[j : j + n] * by[1, j]
    return main, (check >> CHECK).astype(np.uint32)


# --- packed columns: laid out byte by byte, some as differences from row to row, so that what is constant compresses -------------------

#: Kind, bytes that are kept, whether as differences.
HASH, MARK = ("<u8", 8, False), (("<i8", 8, True), ("<i8", 8, True), ("<u4", 4, True))
BATCH, MARKS, RUN = (HASH, ("<u4", 3, False), *MARK), MARK, (("<u8", 8, True), ("<u4", 3, False))


def _pack(columns: Iterable[np.ndarray], spec: tuple) -> bytes:
    out = []
    for c, (kind, width, differences) in zip(columns, spec, strict=True):
        size = np.dtype(kind).itemsize
        bits = np.ascontiguousarray(c).view(f"<u{size}")
        out = out or [np.array([len(bits)], "<u8").tobytes()]
        if differences and len(bits):
            bits = np.concatenate((bits[:1], bits[1:] - bits[:-1]))
        out.append(np.ascontiguousarray(bits.view(np.uint8).reshape(-1, size).T[:width]).tobytes())
    return b"".join(out)


def _unpack(blob: bytes, spec: tuple) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(blob, "<u8", 1)[0]), 8, []
    for kind, width, differences in spec:
        size = np.dtype(kind).itemsize
        planes = np.zeros((n, size), np.uint8)
        planes[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n).T
        at += n * width
        bits = planes.view(f"<u{size}").reshape(-1)
        out.append((np.cumsum(bits, dtype=bits.dtype) if differences else bits).view(kind))
    return out


def _group_of(doc: np.ndarray, groups: int) -> np.ndarray:
    return ((doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(groups)


class _Marks:
    """Windows to remove, gathered over what a task sees; a payload for each group of documents."""

    def __init__(self, groups: int):
        self.groups, self.held, self.n = groups, [], 0

    def add(self, doc: np.ndarray, key: np.ndarray, pos: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        self.held.append((doc, key, pos))
        self.n += len(doc)
        if self.n >= MARKS_AT_ONCE:
            yield from self.rest()

    def rest(self) -> Iterator[tuple[int, int, bytes]]:
        if self.n:
            doc, key, pos = (np.concatenate([h[i] for h in self.held]) for i in range(3))
            self.held, self.n = [], 0
            group = _group_of(doc, self.groups).astype(np.uint32)
            order = np.lexsort((pos, key, doc, group))
            group = group[order]
            for part in np.split(order, np.flatnonzero(group[1:] != group[:-1]) + 1):
                yield int(_group_of(doc[part[:1]], self.groups)[0]), 2, _pack((doc[part], key[part], pos[part]), MARKS)


class _Frequent:
    """Windows that a task has seen repeatedly, a bounded number, with their earliest places so far: later ones need not be sent."""

    def __init__(self) -> None:
        self.columns = [np.zeros(0, d) for d in (np.uint64, np.uint32, np.int64, np.uint32)]

    def later(self, main: np.ndarray, check: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Whether a known place is earlier; where it is not, the window's own becomes the known one."""
        known, checks, docs, places = self.columns
        out = np.zeros(len(main), bool)
        if not len(known):
            return out
        at = np.minimum(np.searchsorted(known, main), len(known) - 1)
        met = np.flatnonzero((known[at] == main) & (checks[at] == check))
        at = at[met]
        before = (docs[at] < doc[met]) | ((docs[at] == doc[met]) & (places[at] < pos[met]))
        out[met[before]] = True
        earlier = ~before
        docs[at[earlier]], places[at[earlier]] = doc[met[earlier]], pos[met[earlier]]
        return out

    def add(self, main: np.ndarray, check: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> None:
        if not len(main):
            return
        columns = [np.concatenate((new, old)) for new, old in zip((main, check, doc, pos), self.columns, strict=True)]
        columns = [c[:FREQUENT] for c in columns]
        order = np.lexsort((columns[3], columns[2], columns[0]))
        main = columns[0][order]
        order = order[np.concatenate(([True], main[1:] != main[:-1]))]
        self.columns = [c[order] for c in columns]


def _events(rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Record batches of a bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size >= PAYLOAD:
            yield _event(held)
            held, size = [], 0
    if held:
        yield _event(held)


def _event(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([o[0] for o in rows], pa.int32()), pa.array([o[1] for o in rows], pa.int32()), pa.array([o[2] for o in rows], pa.binary())], ["bucket", "kind", "payload"])


def _later(main: np.ndarray, check: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether an equal window starts earlier among these; and which are the earliest of several."""
    out, heads = np.zeros(len(main), bool), np.zeros(len(main), bool)
    order = np.argsort(main, kind="stable")
    ranked = main[order]
    same = np.zeros(len(main), bool)
    same[1:] = ranked[1:] == ranked[:-1]
    same[:-1] |= same[1:]
    some = order[same]
    if len(some):
        some = some[np.lexsort((pos[some], doc[some], check[some], main[some]))]
        m, c, d, p = main[some], check[some], doc[some], pos[some]
        new = np.concatenate(([True], (m[1:] != m[:-1]) | (c[1:] != c[:-1])))
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        out[some] = (d != d[head]) | (p != p[head])
        heads[some[new]] = True
    return out, heads


def _within(main: np.ndarray, check: np.ndarray, run: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether a run, sorted by fingerprint and check, holds these windows."""
    known, checks = run
    out = np.zeros(len(main), bool)
    if not len(known) or not len(main):
        return out
    at = np.searchsorted(known, main)
    open_ = np.flatnonzero(at < len(known))
    while len(open_):  # equal fingerprints with other checks lie side by side
        open_ = open_[known[at[open_]] == main[open_]]
        out[open_] |= checks[at[open_]] == check[open_]
        open_ = open_[~out[open_]]
        at[open_] += 1
        open_ = open_[at[open_] < len(known)]
    return out


def _distinct(main: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((check, main))
    main, check = main[order], check[order]
    keep = np.concatenate(([True], (main[1:] != main[:-1]) | (check[1:] != check[:-1]))) if len(main) else np.zeros(0, bool)
    return main[keep], check[keep]


# --- steps ---------------------------------------------------------------------------------------------------------------------


def _hashed(docs: DataFrame, window: int, buckets: int, groups: int) -> DataFrame:
    """Of (doc_id, doc_key, text): for each slice of texts and bucket its first windows (kind 1), and its repeated ones (kind 2)."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, marks, frequent = WordHashes(CACHE_WORDS), _Marks(groups), _Frequent()
        for batch in slices(batches, "text", SLICE):
            ids = batch.column("doc_id").fill_null(FIRST).to_numpy(zero_copy_only=False)
            keys = batch.column("doc_key").to_numpy(zero_copy_only=False)
            order = np.argsort(ids, kind="stable")
            texts = batch.column("text")
            found, sizes, rows = [], [], []
            for i in order.tolist():
                words = (texts[i].as_py() or "").encode().split()
                if len(words) >= window:
                    found.append(hasher.of(words))
                    sizes.append(len(words))
                    rows.append(i)
            if not found:
                continue
            length = np.array(sizes)
            main, check = _windows(np.concatenate(found), window)
            begin = np.cumsum(length) - length
            pos = np.arange(length.sum()) - np.repeat(begin, length)
            valid = np.flatnonzero(pos <= np.repeat(length - window, length))
            owner = np.repeat(np.array(rows), length)[valid]
            main, check, pos = main[valid], check[valid], pos[valid].astype(np.uint32)
            doc, key = ids[owner], keys[owner]
            later, heads = _later(main, check, doc, pos)
            known = frequent.later(main, check, doc, pos)
            frequent.add(*(x[heads & ~known] for x in (main, check, doc, pos)))
            later |= known
            out = list(marks.add(doc[later], key[later], pos[later]))
            main, check, doc, key, pos = (x[~later] for x in (main, check, doc, key, pos))
            bucket = (main >> shift).astype(np.uint32)
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            edges = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)])) if len(bucket) else np.zeros(1, np.int64)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                x = order[a:b]
                out.append((int(bucket[a]), 1, _pack((main[x], check[x], doc[x], key[x], pos[x]), BATCH)))
            yield from _events(out)
        yield from _events(list(marks.rest()))

    return docs.select("doc_id", "doc_key", "text").mapInArrow(trimmed(run), EVENT)


def _merged(events: DataFrame, groups: int, keep: bool) -> DataFrame:
    """Rows come sorted by bucket and kind: runs to compact (-1), other runs (0), the batch's windows (1), repeats found before (2).

    Yields marks (kind 2) and, to be kept, a new run (kind 0): what is new in the batch, with the runs to compact.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        marks = _Marks(groups)
        rows = ((b, k, p) for batch in batches for b, k, p in zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist(), batch.column("payload"), strict=True))
        for bucket, group in groupby(rows, key=lambda r: r[0]):
            runs, old, batch = [], [], []
            for _, kind, payload in group:
                if kind == 2:
                    yield _event([(bucket, 2, payload.as_py())])
                elif kind == 1:
                    batch.append(_unpack(payload.as_buffer(), BATCH))
                else:
                    runs.append(_unpack(payload.as_buffer(), RUN))
                    if kind == -1:
                        old.append(runs[-1])
            main, check, doc, key, pos = (np.concatenate([x[i] for x in batch]) if batch else np.zeros(0, BATCH[i][0]) for i in range(5))
            batch.clear()
            known = np.zeros(len(main), bool)
            for r in runs:
                known |= _within(main, check, r)
            gone = known | _later(main, check, doc, pos)[0]
            for o in marks.add(doc[gone], key[gone], pos[gone]):
                yield _event([o])
            if keep and (len(main) or old):
                yield _event([(bucket, 0, _pack(_distinct(np.concatenate([main[~known], *(o[0] for o in old)]), np.concatenate([check[~known], *(o[1] for o in old)])), RUN))])
        for o in marks.rest():
            yield _event([o])

    return events.mapInArrow(trimmed(run), EVENT)


def _spans(marks: DataFrame, window: int) -> DataFrame:
    """doc_id, doc_key and the word ranges to remove, as pairs of unsigned 32-bit integers; marks come sorted by group."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        rows = ((b, p) for batch in batches for b, p in zip(batch.column("bucket").to_pylist(), batch.column("payload"), strict=True))
        for _, group in groupby(rows, key=lambda r: r[0]):
            held = [_unpack(p.as_buffer(), MARKS) for _, p in group]
            doc, key, pos = (np.concatenate([h[i] for h in held]) for i in range(3))
            held.clear()
            order = np.lexsort((pos, key, doc))
            doc, key, pos = doc[order], key[order], pos[order].astype(np.int64)
            new_doc = np.concatenate(([True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])))
            new_span = new_doc | np.concatenate(([True], pos[1:] > pos[:-1] + window))
            first = np.flatnonzero(new_span)
            last = np.append(first[1:], len(pos)) - 1
            pairs = np.stack([pos[first], pos[last] + window], axis=1).astype("<u4")
            head = np.flatnonzero(new_doc[first])
            made = [pairs[a:b].tobytes() for a, b in zip(head.tolist(), np.append(head[1:], len(first)).tolist(), strict=True)]
            ids = doc[first[head]]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=ids == FIRST), pa.array(key[first[head]]), pa.array(made, pa.binary())], ["doc_id", "doc_key", "spans"])

    return marks.mapInArrow(trimmed(run), "doc_id long, doc_key long, spans binary")


def _power(n: float) -> int:
    """The least power of two that is not below n."""
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, n)))))


class FingerprintIndex:
    """Runs of window hashes in a folder; `add` finds what a batch repeats and, unless told otherwise, adds the batch's windows.

    windows: how many a batch will have, about. An index that the folder holds already is opened, with its own settings.
    """

    def __init__(self, spark: SparkSession, path: str, window: int = WINDOW, windows: float = 0, buckets: int | None = None):
        self.spark, self.work, self.width = spark, Workspace(spark, path=path), partitions(spark)
        self.groups = _power(max(8, windows / GROUP_MARKS, self.width / 3))
        self.window, self.buckets = window, buckets or _power(max(16, windows / BUCKET_WINDOWS, self.width))
        #: Number and windows of each run, the oldest first.
        self.runs: list[tuple[int, int]] = []
        self.n = 0
        if self.work.exists("manifest"):
            rows = spark.read.schema(self.MANIFEST).parquet(f"{path}/manifest").collect()  # a row for each run
            head = rows[0]
            self.window, self.buckets, self.n = head.window, head.buckets, head.n
            self.runs = sorted((r.run, r.windows) for r in rows if r.run is not None)

    MANIFEST = "window int, buckets int, n int, run int, windows long"

    def _write_manifest(self) -> None:
        rows = [(self.window, self.buckets, self.n, r, w) for r, w in self.runs or [(None, 0)]]
        self.work.write(self.spark.createDataFrame(rows, self.MANIFEST).coalesce(1), "manifest")

    def _sorted(self, rows: DataFrame, *by: str) -> DataFrame:
        return rows.repartition(self.width, by[0]).sortWithinPartitions(*by)

    def _read(self, n: int, kind: int) -> DataFrame:
        return self.spark.read.schema(f"{EVENT.replace('kind int, ', '')}, kind int").parquet(f"{self.work.path}/batch-{n}").filter(F.col("kind") == kind).select("bucket", "kind", "payload")

    def add(self, docs: DataFrame, keep: bool = True, windows: int | None = None) -> DataFrame:
        """Of (doc_id, doc_key, text) whose doc_ids are larger than all before: the marks of windows that started earlier. windows: how many, about."""
        own, size, old = self.n, windows, []
        if keep and size is None:
            size = docs.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // BYTES_A_WINDOW
        while keep and self.runs and self.runs[-1][1] <= 1.5 * (size + sum(w for _, w in old)):
            old.insert(0, self.runs.pop())
        events = _hashed(docs, self.window, self.buckets, self.groups)
        for n, _ in self.runs:
            events = events.unionByName(self._read(n, 0))
        for n, _ in old:
            events = events.unionByName(self._read(n, 0).withColumn("kind", F.lit(-1)))
        self.n += 1
        # one table holds both results of the batch: its run and its marks
        self.work.write(_merged(self._sorted(events, "bucket", "kind"), self.groups, keep), f"batch-{own}", ["kind"])
        del events
        if keep:
            self.runs.append((own, size + sum(w for _, w in old)))
            self._write_manifest()
            for n, _ in old:  # the marks of that batch stay
                self.work.drop(f"batch-{n}/kind=0")
        release(self.spark)
        return self._read(own, 2)

    def spans(self, marks: DataFrame) -> DataFrame:
        return _spans(self._sorted(marks, "bucket"), self.window)


def removable(docs: DataFrame, window: int = WINDOW, batches: int | None = None) -> DataFrame:
    """doc_id, doc_key, spans: the word ranges that each document loses; documents are added in batches of ascending doc_id."""
    spark = docs.sparkSession
    work = Workspace(spark, "substring")
    quantiles = lambda n: F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [1.0], 10_000)
    fixed, batches = batches, batches or BATCHES
    size, cuts = docs.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), quantiles(batches)).first()
    if not fixed and size > batches * BATCH_BYTES:
        batches = -(-size // BATCH_BYTES)
        cuts = docs.select(quantiles(batches)).first()[0]
    windows = size // BYTES_A_WINDOW // batches
    index = FingerprintIndex(spark, f"{work.path}/index", window, windows)
    bounds = sorted(set(cuts or [])) if batches > 1 else []
    marks = None
    for i in range(len(bounds) + 1):
        own = docs
        if i:
            own = own.filter(F.col("doc_id") > bounds[i - 1])
        if i < len(bounds):
            own = own.filter((F.col("doc_id") <= bounds[i]) | (F.col("doc_id").isNull() if i == 0 else F.lit(False)))
        found = index.add(own, keep=i < len(bounds), windows=windows)
        marks = found if marks is None else marks.unionByName(found)
    out = work.save(index.spans(marks), "spans")
    work.drop("index")
    release(spark)
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text by their types, and a key that tells rows of one doc_id apart; 0 where there is one only."""
    plain = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    several = plain.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias(f"{KEY}_doc"), F.lit(True).alias(f"{KEY}_of"))
    n = several.count()
    if not n:
        return plain.withColumn(KEY, F.lit(0).cast("long"))
    marked = plain.join(F.broadcast(several) if n <= BROADCAST_ROWS else several, plain["doc_id"].eqNullSafe(several[f"{KEY}_doc"]), "left")
    return marked.withColumn(KEY, F.when(F.col(f"{KEY}_of"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))).drop(f"{KEY}_doc", f"{KEY}_of")


def _joined(docs: DataFrame, window: int, batches: int | None) -> DataFrame:
    keyed = _keyed(docs)
    spans = removable(keyed.select("doc_id", F.col(KEY).alias("doc_key"), "text"), window, batches).select(F.col("doc_id").alias(f"{KEY}_doc"), F.col("doc_key").alias(f"{KEY}_of"), F.col("spans").alias(SPANS))
    return keyed.join(spans, keyed["doc_id"].eqNullSafe(spans[f"{KEY}_doc"]) & (keyed[KEY] == spans[f"{KEY}_of"]), "left").drop(f"{KEY}_doc", f"{KEY}_of", KEY)


def _kept(words: list, spans: bytes | None) -> list:
    if not spans:
        return words
    out, at = [], 0
    for a, b in np.frombuffer(spans, "<u4").reshape(-1, 2).tolist():
        out += words[at:a]
        at = b
    return out + words[at:]


def deduplicate(docs: DataFrame, window: int = WINDOW, batches: int | None = None) -> DataFrame:
    """The rows with what started earlier taken out of their texts: a document that loses words has the kept ones joined by one space; the others stay as they are. Adds n_removed."""
    joined = _joined(docs, window, batches)
    fields = [f for f in joined.schema if f.name not in (SPANS, "n_removed")]
    schema = T.StructType([*fields, T.StructField("n_removed", T.LongType())])

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(rows, "text"):
            texts, removed = [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column(SPANS).to_pylist(), strict=True):
                words = text.encode().split() if spans else []
                kept = _kept(words, spans)
                removed.append(len(words) - len(kept))
                texts.append(b" ".join(kept).decode() if spans else text)
            columns = [pa.array(texts, pa.string()) if f.name == "text" else batch.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, pa.int64())], [*(f.name for f in fields), "n_removed"])

    return joined.select(*(f.name for f in fields), SPANS).mapInArrow(trimmed(run), schema)


def digests(docs: DataFrame, window: int = WINDOW, batches: int | None = None) -> DataFrame:
    joined = _joined(docs.select("doc_id", "text"), window, batches)

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(rows, "text"):
            n_words, n_removed, digest = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column(SPANS).to_pylist(), strict=True):
                words = (text or "").encode().split()
                kept = _kept(words, spans)
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return joined.select("doc_id", "text", SPANS).mapInArrow(trimmed(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (SELECT doc_id, w, len(w) AS n FROM d),
starts AS (SELECT doc_id, w, unnest(range(1, n - 18)) AS s FROM n WHERE n >= 20),
windows AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS v FROM starts),
ranked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY v ORDER BY doc_id, s) AS r FROM windows),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM ranked WHERE r > 1) GROUP BY doc_id),
flat AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, n + 1)) AS p FROM n),
hit AS (SELECT doc_id, unnest(ps) AS p FROM gone),
kept AS (SELECT f.doc_id, count(*) AS k, string_agg(x, ' ' ORDER BY f.p) AS t FROM flat f ANTI JOIN hit h ON f.doc_id = h.doc_id AND f.p = h.p GROUP BY f.doc_id)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_words, CAST(n.n - coalesce(kept.k, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM n LEFT JOIN kept ON n.doc_id = kept.doc_id
"""
