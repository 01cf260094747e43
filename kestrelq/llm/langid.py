"""Language identification as inference of a mixture.

For each language a model of letter trigrams within words is learned. A word's likelihood in a language is the product of its trigrams';
a document is a mixture of languages that its words are drawn from. Expectation-maximisation estimates the proportions, and the set
of languages grows one by one, each time by the language that raises the likelihood most, as long as the gain exceeds a penalty in
the logarithm of the number of words. The prediction is the language with the largest proportion, the score is that proportion.

Models are fitted on at most `SAMPLE` documents a language, those with the smallest hashes of doc_id; the window that ranks them meets
only rows with a hash below a bound that follows the language's number of rows. Trigrams are counted where the documents are, and one
vector of `GRAMS` counts a language reaches the driver.

Defined results: a null text, or one without a letter, is `und` with score 0; so is every text if nothing was learned; rows with null
lang, null doc_id or a null text teach nothing, rows that repeat a doc_id once; very long texts are read whole, each different word once;
languages that are equally likely are taken in alphabetical order; repeated rows get equal results; an empty table gives an empty one;
other columns pass through, but lang_pred and score are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrelq.llm.common import slices, small_hash_sample, table, train_fold, trimmed

FOLDS, HELD_OUT = 5, 0
SAMPLE, GRAMS, SMOOTH = 1_500, 1 << 16, 0.5
PENALTY, EM_STEPS, EM_CLOSE = 3.0, 40, 1e-4
CACHE_WORDS, CACHE_CHARS = 300_000, 48
UNDETERMINED = "und"


def letters(word: str) -> str:
    return word if word.isalpha() else "".join(c if c.isalpha() else " " for c in word)


def grams(word: str) -> list[int]:
    """Hashed trigrams of the word's runs of letters, with their edges."""
    out: list[int] = []
    for run in letters(word.lower()).split():
        padded = f"_{run}_"
        out += [zlib.crc32(padded[i : i + 3].encode()) % GRAMS for i in range(len(padded) - 2)]
    return out


class Mixture:
    """Log-probabilities of trigrams by language, and the inference."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        """counts: a row a language."""
        self.languages = languages
        self.log = np.log((counts + SMOOTH) / (counts.sum(axis=1, keepdims=True) + SMOOTH * GRAMS)).T.copy() if languages else np.zeros((GRAMS, 0))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.languages)))
        self.used = 0

    def _row(self, word: str) -> int:
        """Position of the word's log-likelihoods in the table; -1 if it has no letter."""
        at = self.known.get(word)
        if at is None:
            found = grams(word)
            at = -1
            if found:
                if self.used == len(self.table):
                    self.table = np.concatenate((self.table, np.zeros_like(self.table)))
                at = self.used
                self.table[at] = self.log[found].sum(axis=0)
                self.used += 1
            self.known[word] = at
        return at

    def rows(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods of the text's different words, and how often each occurs."""
        if self.used > CACHE_WORDS:
            self._forget()
        words = text.split()
        try:
            at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        except KeyError:
            at = np.fromiter(map(self._row, words), np.int64, len(words))
        which, often = np.unique(at[at >= 0], return_counts=True)
        out = self.table[which]
        if max(map(len, words), default=0) > CACHE_CHARS:  # long ones are not kept for other texts
            for w in words:
                if len(w) > CACHE_CHARS:
                    self.known.pop(w, None)
        return out, often.astype(float)

    def infer(self, text: str | None) -> tuple[str, float]:
        chosen, weights = self.proportions(text)
        if not chosen:
            return UNDETERMINED, 0.0
        best = int(np.argmax(weights))
        return self.languages[chosen[best]], float(weights[best])

    def proportions(self, text: str | None) -> tuple[list[int], np.ndarray]:
        """The languages chosen and their proportions."""
        if not text or not self.languages:
            return [], np.zeros(0)
        rows, often = self.rows(text)
        if not len(rows):
            return [], np.zeros(0)
        alone = often @ rows
        chosen, weights = [int(np.argmax(alone))], np.ones(1)
        likely, penalty = float(alone[chosen[0]]), PENALTY * np.log1p(often.sum())
        current = rows[:, chosen[0]]
        while len(chosen) < len(self.languages):
            best = None
            for new in range(len(self.languages)):
                # what the language could add at most bounds what it does add
                if new in chosen or often @ np.maximum(rows[:, new] - current, 0) <= penalty:
                    continue
                found, now = _em(rows[:, [*chosen, new]], often, np.append(weights * 0.9, 0.1))
                if best is None or now > best[2]:
                    best = (new, found, now)
            if best is None or best[2] - likely <= penalty:
                break
            chosen, weights, likely = [*chosen, best[0]], best[1], best[2]
            current = np.logaddexp.reduce(rows[:, chosen] + np.log(np.maximum(weights, 1e-12)), axis=1)
        return chosen, weights


def _em(rows: np.ndarray, often: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions, and the log-likelihood of the words under them."""
    top = rows.max(axis=1)
    likely, total = np.exp(rows - top[:, None]), often.sum()
    for _ in range(EM_STEPS):
        each = likely @ weights
        new = weights * (likely.T @ (often / each)) / total
        close = np.abs(new - weights).max() < EM_CLOSE
        weights = new
        if close:
            break
    return weights, float(often @ (np.log(np.maximum(likely @ weights, 1e-300)) + top))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Mixture:
    """Learns from doc_id, text and lang of the rows outside the held-out fold."""
    known = train_fold(docs.select("doc_id", "lang").filter("lang IS NOT NULL AND text IS NOT NULL"), FOLDS, HELD_OUT).filter("NOT held_out")
    # the sample's size is fixed for each language, so it may be broadcast
    chosen = F.broadcast(small_hash_sample(known.select("doc_id", "lang").distinct(), "lang", ["doc_id"], sample).select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("sample_lang")))
    found = docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang").join(chosen, (F.col("doc_id") == F.col("sample_id")) & (F.col("lang") == F.col("sample_lang")))
    texts = found.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")  # rows that repeat a doc_id teach once

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = np.array([g for w in (text or "").split() for g in grams(w)], np.int64)
                found[lang] = found.get(lang, np.zeros(GRAMS, np.int64)) + np.bincount(own, minlength=GRAMS)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([x.tobytes() for x in found.values()], pa.binary())], ["lang", "counts"])

    def total(key: tuple, rows: pa.Table) -> pa.Table:
        return pa.table({"lang": [key[0].as_py()], "counts": [sum(np.frombuffer(x.as_py(), np.int64) for x in rows.column("counts")).tobytes()]}, pa.schema([("lang", pa.string()), ("counts", pa.binary())]))

    summed = texts.mapInArrow(trimmed(count), "lang string, counts binary").groupBy("lang").applyInArrow(total, "lang string, counts binary").collect()  # a row a language
    summed.sort(key=lambda r: r.lang)
    return Mixture([r.lang for r in summed], np.array([np.frombuffer(bytes(r.counts), np.int64) for r in summed], float))


def identify(docs: DataFrame, model: Mixture) -> DataFrame:
    """The rows with lang_pred and score; other columns pass through."""
    fields = [f for f in docs.schema if f.name not in ("lang_pred", "score")]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.log))  # GRAMS numbers a language

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Mixture([], np.zeros((0, GRAMS)))
        own.languages, own.log = shared.value
        own._forget()
        for batch in slices(batches, "text"):
            made = [own.infer(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], [f.name for f in schema])

    return docs.mapInArrow(trimmed(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return identify(train_fold(docs.drop("lang"), FOLDS, HELD_OUT), fit(docs)).select("doc_id", "held_out", "lang_pred", "score")
