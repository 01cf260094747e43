"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

Each item is a set of windows of `WINDOW` consecutive words; an item of fewer words is one window. A window can only occur where its
rarest word occurs, so that word alone is its necessary prefix: words are ordered by how often they occur in all documents (one pass,
counting only words of the benchmark), and documents' words are joined with prefixes. A candidate must pass the positional bound
(the window, set on the prefix's offset, lies within the document, which is also the length bound) and is then verified word by word.

Words are taken from a text once: a table of them serves the count and the join. The prefixes are broadcast while the benchmark's windows
and their items are within `BROADCAST_BYTES`; beyond that the same join is a shuffled one, whose large keys adaptive execution splits.

Defined results: null texts have no words; very long texts are one row like others; an item without words has no window; a null item_id is
counted in no n_items, but its windows hit; of words equally rare the smaller one is the prefix; rows of equal doc_id and text get equal
results; repeated items count once by item_id; an empty benchmark hits nothing; an empty documents table gives an empty result; other
columns, also those named like its own, are ignored, and `clean` passes them through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelq.llm.common import Workspace, table

WINDOW, LEAST_ITEMS = 8, 2
BROADCAST_BYTES = 32_000_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column | str) -> Column:
    """A-Z lowered and the words taken; texts of ASCII alone take the faster way to the same result."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Different windows with the items that hold them."""
    held = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text").cast("string")).alias("words")).filter("size(words) > 0")
    cut = held.withColumn("at", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - F.lit(window - 1)))))
    return cut.select("item_id", F.slice("words", F.col("at"), window).alias("window")).groupBy("window").agg(F.collect_set("item_id").alias("items"))


def prefixes(tokens: DataFrame, windows: DataFrame, broadcast: bool) -> DataFrame:
    """Each window with its rarest word in the documents, that word's first offset in it, and the window's items."""
    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    spread = tokens.select(F.explode("words").alias("word"))
    counts = spread.join(F.broadcast(vocabulary) if broadcast else vocabulary, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    placed = windows.select("window", "items", F.posexplode("window").alias("offset", "word"))
    ranked = placed.join(counts, "word", "left").select("window", "items", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset").alias("rank"))
    # a word that no document has can't be joined, so that its windows cost nothing further
    return ranked.groupBy("window").agg(F.min("rank").alias("rank"), F.first("items").alias("items")).filter("rank.n > 0").select("window", "items", F.col("rank.word").alias("prefix"), F.col("rank.offset").alias("offset"), F.size("window").alias("length"))


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row for each occurrence, and one for each document's begin (position 0, maybe without occurrence) with its number of words.

    doc_id, doc_key (of the text), position, n_words, begin and length (in words) and items of the occurrence.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "decontaminate")
    windows = work.save(item_windows(benchmark, window), "windows")
    size = windows.agg(F.coalesce(F.sum(F.octet_length(F.array_join("window", " ")) + F.octet_length(F.array_join("items", " ")) + 16 * (F.size("window") + F.size("items"))), F.lit(0))).first()[0]
    small = size <= BROADCAST_BYTES
    # no word holds a space
    taken = work.save(docs.select("doc_id", F.xxhash64("text").alias("doc_key"), F.array_join(words("text"), " ").alias("joined")), "words")
    tokens = taken.select("doc_id", "doc_key", F.when(F.col("joined") == "", F.array().cast("array<string>")).otherwise(F.split("joined", " ")).alias("words"))
    found = work.save(prefixes(tokens, windows, small), "prefixes")
    if not small:
        return _shuffled(tokens, found)
    # one pass: the words array is read where it is spread, and never leaves its row
    spread = tokens.select("doc_id", "doc_key", "words", F.posexplode_outer("words").alias("at", "word"))
    at = F.col("at") - F.col("offset")
    verified = (F.col("word") == F.col("prefix")) & (at >= 0) & (at + F.col("length") <= F.size("words")) & (F.slice("words", F.greatest(at, F.lit(0)) + 1, F.col("length")) == F.col("window"))
    joined = spread.join(F.broadcast(found), verified, "left")
    return joined.filter("length IS NOT NULL OR coalesce(at, 0) = 0").select("doc_id", "doc_key", F.coalesce("at", F.lit(0)).alias("position"), F.size("words").cast("long").alias("n_words"), at.alias("begin"), "length", "items")


def _shuffled(tokens: DataFrame, found: DataFrame) -> DataFrame:
    """The same rows with shuffled joins: single words meet prefixes, and only candidates meet their documents again."""
    spread = tokens.select("doc_id", "doc_key", F.size("words").alias("n"), F.posexplode("words").alias("at", "word"))
    begin = (F.col("at") - F.col("offset")).alias("begin")
    candidates = spread.join(found, F.col("word") == F.col("prefix")).select(F.col("doc_id").alias("c_doc"), F.col("doc_key").alias("c_key"), "n", "at", begin, "length", "window", "items").filter("begin >= 0 AND begin + length <= n")
    checked = tokens.join(candidates, F.col("doc_id").eqNullSafe(F.col("c_doc")) & (F.col("doc_key") == F.col("c_key"))).filter(F.slice("words", F.col("begin") + 1, F.col("length")) == F.col("window"))
    whole = tokens.select("doc_id", "doc_key", F.lit(0).alias("position"), F.size("words").cast("long").alias("n_words"))
    hits = checked.select("doc_id", "doc_key", F.col("at").alias("position"), F.col("n").cast("long").alias("n_words"), "begin", "length", "items")
    return whole.unionByName(hits, allowMissingColumns=True)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_items: int = LEAST_ITEMS) -> DataFrame:
    """doc_id, doc_key, n_words, n_hit, items (sorted), contaminated; a row for each different (doc_id, text)."""
    found = occurrences(docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")), benchmark, window)
    grouped = found.groupBy("doc_id", "doc_key").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("length").isNotNull(), F.struct("begin", (F.col("begin") + F.col("length")).alias("end"))))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    # spans come sorted: each adds what reaches beyond all before it
    state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    covered = F.aggregate(
        "spans",
        state,
        lambda s, x: F.struct((s["n"] + F.greatest(x["end"] - F.greatest(x["begin"], s["to"]), F.lit(0))).alias("n"), F.greatest(s["to"], x["end"]).alias("to")),
        lambda s: s["n"],
    )
    return grouped.select("doc_id", "doc_key", "n_words", covered.cast("long").alias("n_hit"), "items", (F.size("items") >= least_items).alias("contaminated"))


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = contamination(docs, benchmark).withColumnRenamed("doc_id", "found_doc")
    rows = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("row_key"))
    back = rows.join(found, rows["doc_id"].eqNullSafe(found["found_doc"]) & (rows["row_key"] == found["doc_key"]))  # repeated rows come back
    return back.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_items: int = LEAST_ITEMS) -> DataFrame:
    """The rows of documents that are not contaminated, with their columns as they are."""
    found = contamination(docs, benchmark, window, least_items).filter("contaminated").select(F.col("doc_id").alias("__kestrelq_hit_doc"), F.col("doc_key").alias("__kestrelq_hit_key"))
    return docs.join(found, docs["doc_id"].eqNullSafe(found["__kestrelq_hit_doc"]) & (F.xxhash64(docs["text"].cast("string")) == found["__kestrelq_hit_key"]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, array_to_string(w[s:s + 7], ' ') AS v, least(len(w), 8) AS k FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 6, 2))) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, s, k, array_to_string(w[s:s + k - 1], ' ') AS v FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, sizes WHERE len(w) >= k)),
occ AS (SELECT dw.doc_id, dw.s, dw.k, iw.item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.v = iw.v),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM occ) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS t FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hits ON d.doc_id = hits.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""
