"""Document fingerprints as homomorphic multiset hashes, in DataFrame operations only.

A text is the multiset of its paragraphs (lines). Each paragraph is hashed to a wide vector: two 64-bit hashes of the whole paragraph as
four words modulo 2^32, and 64 words modulo 2^32, where every pair of neighbouring pieces of the paragraph adds +1 or -1 to each word, as
a bit of its hash says. A fingerprint is the sum of its paragraphs' vectors, each word modulo its power of two, with the number of
pairs. So the order of paragraphs doesn't matter, and a paragraph is inserted or deleted by adding or subtracting its fingerprint
(`add`, `subtract`). The first four words decide equality. The inner product of the 64 signed words estimates how many pairs two
texts share, which gives the likeness.

Sums are plain sums of packed counters: a 64-bit integer counts two bits of the pairs' hashes, so that 32 sums carry 64 words.

The neighbour of a document (descending doc_id; after the last the first) is found in buckets of doc_id, cut at approximate quantiles and
evenly between these, so many that each has about `BUCKET_BYTES` of text: one exchange of the texts, and for each bucket one row more, the
first document of the next bucket.

Defined results: a null text counts as empty; an empty text has one empty paragraph of one pair; very long texts are summed like others, in
words modulo 2^32; null doc_ids come last and rows of equal doc_id in the order of their texts, so each row has a neighbour; equal texts
have equal fingerprints, so ties and repeated rows get equal results up to their neighbours; a single row is its own; an empty table
gives an empty one; other columns, also those named like its own, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrelq.llm.common import Workspace, release, table

LANES, SUMS, WORD, EQUAL = 64, 32, 1 << 32, 1 << 32
#: Quantiles of doc_id: SIDE * SIDE at most, found by two searches of SIDE edges; each is cut evenly into buckets of so many bytes of text.
SIDE, BUCKET_BYTES = 32, 1 << 26
#: A bit of each half of a 64-bit hash.
HALVES = 0x0000000100000001


def vectors(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, pairs, equal (4 words), words (64 words): the fingerprint of each key's text. A key must be of one row."""
    paragraphs = texts.select(key, F.explode(F.split(text, "\n")).alias("paragraph"))
    pieces = paragraphs.select(key, "paragraph", F.split("paragraph", " ").alias("pieces"))
    each = pieces.select(key, "paragraph", "pieces", F.posexplode("pieces").alias("at", "piece"))
    before = F.when(F.col("at") > 0, F.get("pieces", F.col("at") - 1)).otherwise(F.lit(""))
    first = F.col("at") == 0
    hashed = each.select(
        key,
        F.xxhash64(before, "piece").alias("pair"),
        F.when(first, F.xxhash64("paragraph")).otherwise(F.lit(0).cast("long")).alias("one"),
        F.when(first, F.xxhash64(F.lit("2"), "paragraph")).otherwise(F.lit(0).cast("long")).alias("two"),
    )
    low, high = (lambda c: F.col(c).bitwiseAND(EQUAL - 1)), (lambda c: F.shiftrightunsigned(c, 32))
    counted = hashed.groupBy(key).agg(
        F.count("*").alias("pairs"),
        *(F.sum(e).alias(f"e{i}") for i, e in enumerate((low("one"), high("one"), low("two"), high("two")))),
        *(F.sum(F.shiftrightunsigned("pair", i).bitwiseAND(HALVES)).alias(f"s{i}") for i in range(SUMS)),
    )
    ups = [F.col(f"s{i}").bitwiseAND(EQUAL - 1) for i in range(SUMS)] + [F.shiftrightunsigned(f"s{i}", 32) for i in range(SUMS)]
    return counted.select(
        key,
        "pairs",
        F.array(*(F.pmod(F.col(f"e{i}"), F.lit(EQUAL)) for i in range(4))).alias("equal"),
        F.array(*(F.pmod(2 * up - F.col("pairs"), F.lit(WORD)) for up in ups)).alias("words"),
    )


def combined(a: Column, b: Column, sign: int) -> Column:
    """The fingerprint struct of a's multiset with b's added (sign 1) or taken away (sign -1)."""
    return F.struct(
        (a["pairs"] + sign * b["pairs"]).alias("pairs"),
        F.zip_with(a["equal"], b["equal"], lambda x, y: F.pmod(x + sign * y, F.lit(EQUAL))).alias("equal"),
        F.zip_with(a["words"], b["words"], lambda x, y: F.pmod(x + sign * y, F.lit(WORD))).alias("words"),
    )


def add(a: Column, b: Column) -> Column:
    return combined(a, b, 1)


def subtract(a: Column, b: Column) -> Column:
    return combined(a, b, -1)


def as_text(v: Column) -> Column:
    """Pairs and all words as 8 hexadecimal digits each."""
    digits = lambda x, n: F.lpad(F.lower(F.hex(x)), n, "0")
    return F.concat(digits(v["pairs"], 8), F.array_join(F.transform(v["equal"], lambda x: digits(x, 8)), ""), F.array_join(F.transform(v["words"], lambda x: digits(x, 8)), ""))


def likeness(a: Column, b: Column) -> Column:
    """Twice the inner product of the signed words over the sum of their squares, at least 0: the share of pairs that two texts have in common, where what a text repeats weighs by its square."""
    signed = lambda w: F.transform(w, lambda x: (F.pmod(x + WORD // 2, F.lit(WORD)) - WORD // 2).cast("double"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    x, y = signed(a["words"]), signed(b["words"])
    both = 2 * total(F.zip_with(x, y, lambda p, q: p * q))
    alone = total(F.zip_with(x, y, lambda p, q: p * p + q * q))
    return F.when(alone == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), both / alone))


def _bucket(bounds: list[int], least: int, most: int, cuts: int) -> Column:
    """A number that grows with doc_id: how many of the sorted bounds are below it, and its place among even cuts between these."""
    if not bounds:
        coarse = F.lit(0)
    else:
        rows = [bounds[i : i + SIDE] for i in range(0, len(bounds), SIDE)]
        longs = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
        below = lambda xs: F.size(F.filter(xs, lambda b: b < F.col("doc_id")))
        full = below(longs([r[-1] for r in rows]))
        rest = F.get(F.array(*(longs(r) for r in rows)), full)
        coarse = full * SIDE + F.coalesce(F.greatest(below(rest), F.lit(0)), F.lit(0))
    if cuts == 1:
        return coarse
    edges = F.array(*(F.lit(float(x)) for x in (least - 1, *bounds, max(most, *bounds, least))))
    low, high = F.get(edges, coarse), F.get(edges, coarse + 1)
    place = F.floor((F.col("doc_id").cast("double") - low) / F.greatest(F.lit(1.0), high - low) * cuts)
    return coarse * cuts + F.when(F.col("doc_id").isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(place, F.lit(cuts - 1)))).cast("int")


def neighbours(docs: DataFrame) -> DataFrame:
    """row (a number of its own), doc_id, text, next_row, next_text: each document with the next in descending doc_id."""
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = SIDE * SIDE
    found, least, most, size = plain.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n), F.min("doc_id"), F.max("doc_id"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    placed = plain.withColumn("bucket", _bucket(sorted(set(found or [])), least or 0, most or 0, -(-size // (n * BUCKET_BYTES)) or 1))
    tops = sorted(map(tuple, placed.groupBy("bucket").agg(F.max("doc_id")).collect()))  # a row a bucket
    # the last of a bucket is followed by the first of the next lower one, the last of all by the first of all
    heads = [(tops[i][0], *tops[i - 1]) for i in range(len(tops))]
    following = F.broadcast(spark.createDataFrame(heads, "to int, head_bucket int, head_id long"))
    ghosts = placed.join(following, placed["doc_id"].eqNullSafe(following["head_id"])).select("doc_id", "text", F.col("to").alias("bucket"), F.col("head_bucket").alias("ghost_of"))
    every = placed.withColumn("ghost_of", F.lit(None).cast("int")).unionByName(ghosts)
    order = Window.partitionBy("bucket").orderBy(F.col("ghost_of").isNotNull(), F.col("doc_id").desc_nulls_last(), F.col("text"))
    number = lambda bucket, k: F.shiftleft(F.col(bucket).cast("long"), 32) + k
    ranked = every.withColumns({"k": F.row_number().over(order), "next_text": F.lead("text").over(order), "next_ghost": F.lead("ghost_of").over(order)})
    own = ranked.filter(F.col("ghost_of").isNull())
    return own.select(number("bucket", F.col("k")).alias("row"), "doc_id", "text", F.coalesce(number("next_ghost", F.lit(1)), number("bucket", F.col("k") + 1)).alias("next_row"), "next_text")


def digests(docs: DataFrame) -> DataFrame:
    work = Workspace(docs.sparkSession, "multiset")
    size = F.length("text")
    third = F.floor(size / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - third), F.substring("next_text", F.lit(1), third))
    rows = neighbours(docs).select("row", "doc_id", "next_row", "text", edited.alias("edited"), size.cast("long").alias("n_chars"))
    both = rows.select(F.explode(F.array(F.struct((F.col("row") * 2).alias("id"), F.col("text").alias("t")), F.struct((F.col("row") * 2 + 1).alias("id"), F.col("edited").alias("t")))).alias("x")).select("x.id", "x.t")
    facts = rows.select("row", "doc_id", "next_row", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    # both parts read one exchange of the texts
    made = vectors(both, "id", "t")
    path = work.write(made.withColumn("kind", F.lit(0)).unionByName(facts.withColumn("kind", F.lit(1)), allowMissingColumns=True), "parts", ["kind"])
    release(docs.sparkSession)
    parts = docs.sparkSession.read.schema("id long, pairs long, equal array<bigint>, words array<bigint>, row long, doc_id long, next_row long, n_chars long, edited_sha256 string, kind int").parquet(path)
    prints = parts.filter("kind = 0").select("id", F.struct("pairs", "equal", "words").alias("print"))
    side = lambda odd, key, name: prints.filter(F.col("id").bitwiseAND(1) == odd).select(F.shiftright("id", 1).alias(key), F.col("print").alias(name))
    facts = parts.filter("kind = 1").select("row", "doc_id", "next_row", "n_chars", "edited_sha256")
    joined = facts.join(side(0, "row", "own"), "row").join(side(1, "row", "changed"), "row").join(side(0, "next_row", "next"), "next_row")
    own, changed, following = F.col("own"), F.col("changed"), F.col("next")
    return joined.select("doc_id", "n_chars", "edited_sha256", as_text(own).alias("fingerprint"), as_text(changed).alias("edited_fingerprint"), likeness(own, changed).alias("near_edited"), likeness(own, following).alias("near_next"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
