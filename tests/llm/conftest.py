import random
import re

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sentence(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "to", *[f"w{i}" for i in range(400)]]) for _ in range(n))


def corpus(seed=3, n=60):
    """Rows with null keys and texts, empty and very long texts, ties, copies, near copies and repeated rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((i, sentence(rng, rng.choice([1, 3, 5, 40, 120, 300])), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None, "B"])))
    base = sentence(rng, 200)
    for k in range(12):  # near copies
        cut = base.split()
        for _ in range(k):
            cut[rng.randrange(len(cut))] = f"x{rng.randrange(10**6)}"
        rows.append((100 + k, " ".join(cut), "en", "a"))
    rows += [(200, base, "en", "a"), (201, base.upper(), "en", "b"), (202, base.replace(" ", " \n\t "), "en", "a"), (203, base, None, None)]
    rows += [(210, None, "en", "a"), (211, "", "en", "b"), (212, " \n ", None, None), (213, "\n", "en", None), (214, "é ÉÉ 漢字 \x85x y", "fr", "é"), (None, "lost words here", "en", "a"), (None, None, None, None)]
    rows += [(220, "same row", "en", "a")] * 3 + [(220, "same id other text", "en", "a")]
    rows += [(230, " ".join(f"long{i % 5000}" for i in range(150_000)), "en", "c")]
    rows += [(240 + k, "a b c d e f g h a b c d e f g h i j " * 3, "en", "c") for k in range(3)]
    rng.shuffle(rows)
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


@pytest.fixture(scope="session")
def rows_():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows_):
    """The corpus, with extra columns named like columns the operators make."""
    frame = spark.createDataFrame(rows_, SCHEMA).repartition(5)
    extra = {c: frame["n_chars"] for c in ["size", "shard", "node", "link", "part", "place", "hash", "n", "set", "key", "words", "score", "kept", "component", "a", "b"]}
    return frame.withColumns(extra).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")
