"""Rows that every operator must take: nulls, empties, repeats, a long text, columns with names that operators use."""

from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977} of sentence {i}." for i in range(30_000))


def prose(n, words=80):
    """Prose that no rule dislikes, by number."""
    stems = ["thing", "hill", "river", "stone", "cloud"]
    return " ".join(f"{'The ' if i % 9 == 0 else ''}{stems[i % 5]}{(i * 7 + n * 131) % 1009}{'.' if i % 9 == 8 else ''}" for i in range(words))


TEXTS = [
    (1, prose(1)),
    (2, prose(1)),
    (2, prose(1)),
    (3, prose(2) + "\n" + prose(3)),
    (4, None),
    (5, ""),
    (6, " \t\n"),
    (7, LONG),
    (8, "two words"),
    (9, "Two WORDS"),
    (None, prose(4)),
    (None, None),
    (10, "é ü 東京 " * 40 + prose(5)),
    (11, prose(2) + " end"),
    (12, "a" * 900),
]
CLASHES = ["row", "size", "n", "h", "c", "fp", "key", "kept", "shard", "block", "bucket", "taken", "words", "_text", "routed", "spans"]


def odd_documents(spark):
    rows = [(i, text, "en", ["s1", None, "s2"][at % 3], len(text or "")) for at, (i, text) in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({name: F.lit("clash") for name in CLASHES})
