"""Small tables with the awkward rows that every operator must take."""

import random

from pyspark.sql import functions as F

WORDS = "the of and tion ering lo wei über ñandú déjà x1 42 re-do end. stop, go! 漢字 😀".split()
ODD = [
    None, "", " ", "  ", "\n", "a", "a  b", " a ", "a\n\n b", "a \n b  ", "▁x ▁ y", "<s> </s> <0x0A> <unk>", "<|endoftext|> x<|endoftext|>y",
    "\t\ttab\x1c x　y  z", "😀 é \x00 z", "it's  we'll 'S 1,234 ...", "a" * 3000, " \x1c a", "x\xa0 y", "a\r\n b \x85 c", "Same Text here", "Same Text here",
]


def prose(seed: int, words: int) -> str:
    own = random.Random(seed)
    return " ".join(own.choice(WORDS) + own.choice(["", "a", "en", "ly"]) for _ in range(words))


def documents(spark, texts, ids=None):
    """doc_id, text, and columns whose names operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    return df.withColumns({n: F.lit(7) for n in ("row", "key", "bucket", "kind", "length", "print", "rank", "n_words", "score", "at", "t_text", "lane")}).repartition(3)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
