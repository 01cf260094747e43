import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Null, empty, blank, one word, copies, near copies, shared passages, a very long text, odd characters."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    base, passage = prose(rng, 200, words), prose(rng, 60, words)
    near = base.split()
    near[50] = "changed"
    rows = [None, "", "  \n\t ", "word", "Word", base, base, " ".join(near), base.upper(), f"{prose(rng, 30, words)} {passage} {prose(rng, 30, words)}", f"{passage}\n{prose(rng, 40, words)}", "the same words " * 40, "Été ΑΣ ΣΑΣ. İ x 中文字 😀 <|endoftext|> it's", prose(rng, 60_000, words), *(prose(rng, rng.randint(1, 150), words) for _ in range(40))]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Of these texts, with a repeated row and a null doc_id."""
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[5], (None, texts[9], None, None, 1)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns with the names of the operators' own."""
    from pyspark.sql import functions as F

    names = ("score", "predicted", "lang_pred", "spans", "doc_key", "payload", "part", "words", "print", "token_ids", "held_out", "kind", "bucket", "n", "a", "b", "root", "items", "sample_id", "label_id", "gone_id", "hit_doc", "row", "next_text")
    return docs.withColumns({n: F.lit("mine") for n in names})
