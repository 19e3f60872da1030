"""Small tables with the awkward rows that every operator has to take."""

from __future__ import annotations

import random

WORDS = "the of and to in is that it was for on are as with his they at be this have from or one had by word but not what all".split()


def prose(seed: int, n: int, per_line: int = 12) -> str:
    rng = random.Random(seed)
    made = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) if rng.random() < 0.6 else rng.choice(WORDS) for _ in range(n)]
    return "\n".join(" ".join(made[i : i + per_line]) + "." for i in range(0, n, per_line))


def awkward_texts() -> list[str | None]:
    base = prose(1, 120)
    words = base.split(" ")
    return [
        base, base, None, "", " \n\t ", "one", "two words", base.upper(), " ".join(words[:-2] + ["changed"]), "x" * 5000, "a b c d " * 400,
        prose(2, 6000), "日本語 の テキスト です", "é à ü 🙂 <|endoftext|> it's 123", "\x00 nul", "line\nline\nline\n" + prose(3, 60), "### *** $$$ !!! " * 30,
    ]


def documents(spark, texts=None, first: int = 0, extra: bool = True):
    """doc_id, text, lang, source, n_chars, and columns whose names operators use for their own."""
    texts = awkward_texts() if texts is None else texts
    rows = [(first + i, t, "en" if i % 2 else None, "s" if i % 3 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        for name in ("score", "kept", "held_out", "size", "f1", "id", "h", "node", "n", "predicted", "n_tokens"):
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("mine"))
    return df


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
