"""Plain-Python versions of the operators and awkward rows for their tests."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"long{i % 977}" for i in range(30_000))
# doc_id, text, lang, source and columns whose names clash with those that operators use inside.
AWKWARD = [
    (1, "the cat sat on the mat and the dog ran to the park today", "en", "b"),
    (2, None, "en", "a"),
    (3, "", None, "b"),
    (4, "  \t\n ", "en", None),
    (5, "one two", "en", "b"),
    (5, "one two", "en", "b"),
    (6, "The CAT sat on the mat and the dog ran to the park today", "de", "b"),
    (7, LONG, "en", "b"),
    (8, LONG + " tail", "en", "a"),
    (None, "no id here but some words of text", "en", "c"),
    (None, None, None, None),
    (9, "é ü ß 日本語   x", "fr", "c"),
]
CLASHING = ["_id", "n", "size", "score", "key", "block", "rep", "count", "item_id", "source_size", "hashes"]


def words(text, lower=False):
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return WORD.findall(text)


def documents(spark, rows, clashing=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(*r, 0)[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("other") for c in CLASHING}) if clashing else df


def write(df, folder, name):
    df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


class Sets:
    """Union-find over anything."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x, y):
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)
