"""Quality classifier by Bradley-Terry ranking.

Pairs of a good and a bad document (as the labels say) are preferences; a linear score is learned by logistic loss on the differences of
their features, with Newton steps, and cut at the quantile of the labelled scores below which the share of bad labels lies. The score
that is returned is the logistic function of the distance to that cut, so that 0.5 is the cut itself.

`train` learns from every labelled document outside the held-out fold and from all pairs of a good and a bad one. What a document adds to
the gradient depends on its own score and on how the scores of the other label are spread, so sums over all pairs take two passes over a table of
features a step: one counts scores in narrow bins, between which they are dealt linearly, one sums up gradient and Hessian. Means,
spreads and the cut are those of all these rows too. Only sums reach the driver; their size does not follow the rows.

Features are shares of classes of bytes, measures of words and repetition, and how large a part of the words falls to each of
`BUCKETS` hashes of lower-cased words, so that what words say is learned from the labels too.

Features are counts over whole texts, also very long ones, so scoring is one pass without exchange. (`labelled` and `fit` do the same in
memory for rows and pairs of a bounded number; no query uses them.)

Defined results: a null text counts as empty; an empty text has the features of one and a score like any; without labels of both kinds
every score is 0.5; labels without a document, or null, teach nothing; a doc_id with several labels teaches the smallest, one with several
texts the smallest; equal scores at the cut are on one side; repeated rows get equal scores; an empty table gives an empty one; other
columns pass through, but score and predicted are replaced.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrelq.llm.common import Workspace, slices, table, train_fold, trimmed

FOLDS, HELD_OUT = 3, 1
SAMPLE, PAIRS, RIDGE, STEPS, FEW_WORDS = 8_000, 20_000, 1e-3, 25, 5
BUCKETS, CACHE_WORDS = 256, 100_000
#: How much more the weights of words are held back than others, as they are many.
WORD_RIDGE = 30.0
#: Least width of the bins of scores, how many lie on either side of 0, coarse ones, the step that ends the search, multiples of the weights
#: that a step tries, and partial sums that reach the driver.
WIDTH, BINS, COARSE, CLOSE, SCALES, SUMS = 1 / 64, 1 << 13, 48, 1e-2, 2 ** (np.arange(-8, 17) / 4), 64
#: Classes of bytes whose shares are features.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\n\r", b"!?", b".", b",;:", b"*", b"#$%&@^~", b"|", b"<>/\\{}[]_=+", b"\"'`()-", bytes(range(0x80, 0x100)))
_CLASS_OF = np.full(256, len(CLASSES), np.int64)
for _i, _members in enumerate(CLASSES):
    _CLASS_OF[list(_members)] = _i
NAMES = [*(f"class_{i}" for i in range(len(CLASSES) + 1)), "upper_of_letters", "symbols_a_word", "log_words", "word_bytes", "unlike_words", "repeats_next", "repeats_second", "repeated_lines", "longest_word", "empty", *(f"words_{i}" for i in range(BUCKETS))]


class _Buckets(dict):
    """The bucket of a word, for words met so far, up to a number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        made = self[word] = zlib.crc32(word.lower()) % BUCKETS
        return made


_bucket_of = _Buckets()


def features(text: str | None) -> np.ndarray:
    data = (text or "").encode()
    words = data.split()
    n, size = len(words), max(1, len(data))
    share = np.bincount(_CLASS_OF, np.bincount(np.frombuffer(data, np.uint8), minlength=256), len(CLASSES) + 1) / size
    letters = share[0] + share[1]
    lines = data.split(b"\n")
    held = np.bincount(np.fromiter(map(_bucket_of.__getitem__, words), np.int64, n), minlength=BUCKETS)
    return np.array(
        [
            *share,
            share[0] / letters if letters else 0.0,
            share[5:12].sum() * size / max(1, n),
            np.log1p(n),
            min(30.0, sum(map(len, words)) / max(1, n)),
            len(set(words)) / max(1.0, n**0.8),
            sum(map(operator.eq, words, words[1:])) / max(1, n - 1),
            sum(map(operator.eq, words, words[2:])) / max(1, n - 2),
            1 - len(set(lines)) / len(lines),
            np.log1p(max(map(len, words), default=0)),
            float(n == 0),
            *np.sqrt(held / max(1, n)),
        ]
    )


def standard(rows: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Standardised features; those of a few words say little and are drawn towards the mean."""
    n = np.expm1(rows[:, [NAMES.index("log_words")]])
    return np.clip((rows - mean) / spread, -8, 8) * n / (n + FEW_WORDS)


class Ranking:
    """Weights on standardised features, the cut and the scale of the score."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, weights: np.ndarray, cut: float, scale: float):
        self.mean, self.spread, self.weights, self.cut, self.scale = mean, spread, weights, cut, scale

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return standard(rows, self.mean, self.spread) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.raw(rows) - self.cut) / self.scale, -30, 30)))


def fit(rows: np.ndarray, labels: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE) -> Ranking:
    n = len(NAMES)
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        return Ranking(np.zeros(n), np.ones(n), np.zeros(n), 0.0, 1.0)
    mean, spread = rows.mean(axis=0), rows.std(axis=0)
    spread[spread < 1e-9] = 1.0
    z = standard(rows, mean, spread)
    rng = np.random.default_rng(1)
    each = min(pairs, len(good) * len(bad))
    x = z[rng.choice(good, each)] - z[rng.choice(bad, each)]
    w, hold = np.zeros(n), ridge * np.where([name.startswith("words_") for name in NAMES], WORD_RIDGE, 1.0)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))  # that the good one is preferred
        gradient = x.T @ (1 - p) / each - hold * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x / each + np.diag(hold)
        step = np.linalg.solve(hessian, gradient)
        w += step * min(1.0, 5 / max(1e-12, np.linalg.norm(step)))
        if np.abs(step).max() < 1e-6:
            break
    scores = np.sort(z @ w)
    at = int(np.clip(round(len(bad) / len(labels) * len(scores)), 1, len(scores) - 1))
    return Ranking(mean, spread, w, float((scores[at - 1] + scores[at]) / 2), float(max(1e-9, scores.std() / 4)))


def _known(labels: DataFrame) -> DataFrame:
    """label_id and quality, one row each, outside the held-out fold."""
    known = train_fold(labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("quality IN (0, 1) AND doc_id IS NOT NULL"), FOLDS, HELD_OUT).filter("NOT held_out")
    return known.groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").alias("quality"))


def _featured(docs: DataFrame, known: DataFrame) -> DataFrame:
    """features and quality of the documents that are known."""
    found = train_fold(docs.select("doc_id", F.col("text").cast("string").alias("text")), FOLDS, HELD_OUT).filter("NOT held_out").join(known, F.col("doc_id") == F.col("label_id"))
    texts = found.groupBy("label_id").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "quality")).alias("x")).select("x.text", "x.quality")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            made = [features(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), batch.column("quality")], ["features", "quality"])
        _bucket_of.clear()  # workers live on, through stages that need none of it

    return texts.mapInArrow(trimmed(run), "features binary, quality int")


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most `sample` rows outside the held-out fold, those with the smallest hashes of doc_id."""
    chosen = F.broadcast(_known(labels).orderBy(F.xxhash64("label_id"), "label_id").limit(sample))  # the sample's size is fixed
    found = _featured(docs, chosen).collect()
    rows = np.frombuffer(b"".join(bytes(r.features) for r in found), np.float64).reshape(len(found), len(NAMES))
    order = np.lexsort(rows.T)  # the order in which rows arrive must not matter
    return rows[order], np.array([r.quality for r in found], np.int64)[order]

# --- all labelled rows -----------------------------------------------------------------------------------------------------------


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels."""
    return np.frombuffer(b"".join(batch.column("features").to_pylist()), np.float64).reshape(-1, len(NAMES)), batch.column("quality").to_numpy()


def _summed(rows: DataFrame, add: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int, parts: int) -> np.ndarray:
    """The sum over all rows, which lie in so many partitions, of what `add` makes of some features and labels: `size` numbers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += add(*_rows(batch))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for blob in batch.column("sums"):
                total += np.frombuffer(blob.as_buffer(), np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    made = rows.mapInArrow(run, "sums binary")
    if parts > SUMS:
        made = made.repartition(SUMS).mapInArrow(meet, "sums binary")
    return sum((np.frombuffer(bytes(r.sums), np.float64) for r in made.collect()), np.zeros(size))


def _loses(scores: np.ndarray, others: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each score the sum over the others, by counts, of the odds that it loses to them."""
    out = np.zeros(len(scores))
    for i in range(0, len(scores), 512):
        out[i : i + 512] = 1 / (1 + np.exp(np.clip(scores[i : i + 512, None] - others, -30, 30))) @ counts
    return out


def _reach(w: np.ndarray) -> float:
    """What no score exceeds: standardised features are 8 at most."""
    return 8.0 * float(np.abs(w).sum()) + 1e-6


def _coarse(counts: np.ndarray, width: float, first: int, last: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The coarse bin of each bin from the first to the last, the middles' scores, and the counts in coarse bins."""
    at = np.clip((np.arange(2 * BINS) - first) * COARSE // (last - first + 1), 0, COARSE - 1)
    middles = (first - BINS + (np.arange(COARSE) + 0.5) * (last - first + 1) / COARSE) * width
    return at, middles, [np.bincount(at, c, COARSE) for c in counts]


def train(docs: DataFrame, labels: DataFrame, ridge: float = RIDGE) -> Ranking:
    """The ranking of all labelled rows outside the held-out fold, by all pairs of a good and a bad one."""
    work, n = Workspace(docs.sparkSession, "quality"), len(NAMES)
    rows = work.save(_featured(docs, _known(labels)), "features")
    parts = rows.rdd.getNumPartitions()
    # rounded, here and below, as the order in which sums arrive must not matter
    first = _summed(rows, lambda x, q: np.concatenate(([len(q), q.sum()], x.sum(axis=0), (x * x).sum(axis=0))), 2 + 2 * n, parts)
    total, good = int(first[0]), int(first[1])
    bad = total - good
    if not good or not bad:
        work.drop()
        return Ranking(np.zeros(n), np.ones(n), np.zeros(n), 0.0, 1.0)
    mean = np.round(first[2 : 2 + n] / total, 12)
    spread = np.round(np.sqrt(np.maximum(0, first[2 + n :] / total - mean**2)), 9)
    spread[spread < 1e-7 * np.maximum(1, np.abs(mean))] = 1.0
    w, hold, pairs = np.zeros(n), ridge * np.where([name.startswith("words_") for name in NAMES], WORD_RIDGE, 1.0), float(good) * bad

    def placed(x: np.ndarray, q: np.ndarray, w: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        z = standard(x, mean, spread)
        at = z @ w / width
        low = np.floor(at)
        return z, (q != 0).astype(np.int64), low.astype(np.int64) + BINS, at - low

    def spread_of(w: np.ndarray, width: float) -> np.ndarray:
        """Counts of scores by label and bin, dealt between a bin and the next one, and as they are."""
        if not w.any():
            out = np.zeros((2, 2, 2 * BINS))
            out[:, :, BINS] = bad, good
            return out

        def count(x: np.ndarray, q: np.ndarray) -> np.ndarray:
            _, label, low, share = placed(x, q, w, width)
            at = low + 2 * BINS * label
            return np.concatenate((np.bincount(at, 1 - share, 4 * BINS) + np.bincount(at + 1, share, 4 * BINS), np.bincount(at, minlength=4 * BINS)))

        return _summed(rows, count, 8 * BINS, parts).reshape(2, 2, 2 * BINS)

    def slopes(w: np.ndarray, width: float, dealt: np.ndarray, plain: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the mean loss of all pairs: the gradient and about the Hessian, without what holds weights back."""
        scores, met = (np.arange(2 * BINS) - BINS) * width, [np.flatnonzero(c) for c in dealt]
        # how much a row of that score pulls: a bad one down, a good one up
        pull, own = np.zeros((2, 2 * BINS)), slice(first, last + 1)
        pull[0, own] = -_loses(-scores[own], -scores[met[1]], dealt[1, met[1]]) / pairs
        pull[1, own] = _loses(scores[own], scores[met[0]], dealt[0, met[0]]) / pairs
        # the Hessian takes the scores of coarse bins, in all its terms, so that it can't be indefinite; it decides how fast the search is, not its end
        coarse, middles, many = _coarse(plain, width, first, last)
        odds = 1 / (1 + np.exp(np.clip(middles[:, None] - middles, -30, 30)))
        curve = odds * (1 - odds) / pairs
        bend = np.concatenate((curve @ many[1], curve @ many[0]))

        def sums(x: np.ndarray, q: np.ndarray) -> np.ndarray:
            z, label, low, share = placed(x, q, w, width)
            weight, place = (1 - share) * pull[label, low] + share * pull[label, low + 1], coarse[low] + COARSE * label
            held = np.zeros((2 * COARSE, n))
            np.add.at(held, place, z)
            return np.concatenate((weight @ z, held.ravel(), ((z * bend[place][:, None]).T @ z).ravel()))

        gradient, held, squares = np.split(_summed(rows, sums, n + 2 * COARSE * n + n * n, parts), [n, n + 2 * COARSE * n])
        held = held.reshape(2, COARSE, n)
        across = held[1].T @ curve @ held[0]
        return gradient, squares.reshape(n, n) - across - across.T

    for _ in range(STEPS):
        width = max(WIDTH, _reach(w) / (BINS - 4))  # all scores have a bin, and a next one
        dealt, plain = spread_of(w, width)
        held = np.flatnonzero(dealt.sum(axis=0))
        first, last = int(held[0]) - 1, int(held[-1]) + 1
        # the best multiple of the weights, by the counts alone
        _, middles, many = _coarse(plain, width, first, last)
        loss = [np.logaddexp(0, -a * (middles[:, None] - middles)).T.dot(many[1]) @ many[0] / pairs + a * a * (hold * w * w).sum() / 2 for a in SCALES]
        scale = SCALES[int(np.argmin(loss))] if w.any() else 1.0
        w, width = w * scale, width * scale
        gradient, hessian = slopes(w, width, dealt, plain, first, last)
        step = np.linalg.solve(hessian + np.diag(hold), gradient - hold * w)
        w = np.round(w + step * min(1.0, 5 / max(1e-12, np.linalg.norm(step))), 9)
        if np.abs(step).max() < CLOSE:
            break
    cut, deviation = _cut(rows, Ranking(mean, spread, w, 0.0, 1.0), bad, total, parts)
    work.drop()
    return Ranking(mean, spread, w, cut, max(1e-9, deviation / 4))


def _cut(rows: DataFrame, ranking: Ranking, rank: int, total: int, parts: int) -> tuple[float, float]:
    """The middle between the scores of rank - 1 and rank, counted from 0, and the deviation of all: the bins that hold the two are counted again, in finer ones."""
    reach, size, moments = _reach(ranking.weights), 2 * BINS + 2, None
    spans = [(-reach, reach)] * 2
    while max(high - low for low, high in spans) > 1e-6:
        edges = [np.linspace(low, high, 2 * BINS + 1) for low, high in spans]

        def count(x: np.ndarray, q: np.ndarray, edges: list[np.ndarray] = edges) -> np.ndarray:
            raw = ranking.raw(x)
            return np.concatenate(([raw.sum(), raw @ raw], *(np.bincount(np.searchsorted(e, raw, "right"), minlength=size) for e in edges)))

        found = _summed(rows, count, 2 + 2 * size, parts)
        moments = found[:2] / total
        for k in range(2):
            at = int(np.searchsorted(np.cumsum(found[2 + k * size : 2 + (k + 1) * size]), rank - 1 + k, "right"))
            spans[k] = (edges[k][max(0, at - 1)], edges[k][min(at, 2 * BINS)])
    return float(np.mean(spans)), float(np.round(np.sqrt(max(0.0, moments[1] - moments[0] ** 2)), 9))


def score(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """The rows with score and predicted; other columns pass through."""
    fields = [f for f in docs.schema if f.name not in ("score", "predicted")]
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            made = ranking.score(np.stack([features(t) for t in batch.column("text").to_pylist()]))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(made), pa.array((made >= 0.5).astype(np.int32))], [f.name for f in schema])
        _bucket_of.clear()

    return docs.mapInArrow(trimmed(run), schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from all labelled rows of `docs` outside the held-out fold and scores all rows; other columns pass through."""
    return score(docs, train(docs, labels))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    ranking = train(docs, table(spark, sf_dir, "labels"))
    return score(train_fold(docs, FOLDS, HELD_OUT), ranking).select("doc_id", "held_out", "score", "predicted")
