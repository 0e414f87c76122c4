"""A small table with every awkward row: nulls, empty and long texts, ties, repeated rows and clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, TEXT string, part int, h long, rid long, score double, bucket int"
WORDS = "stone river quiet under window letter garden seven yellow carry morning often silver paper road voice".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return "".join(r.choice(WORDS) + r.choice(" " * 12 + "\n") for _ in range(n)).strip()


def rows():
    base, long = prose(1, 120), prose(2, 30_000)
    near = base.split(" ")
    near[40] = "changed"
    texts = [
        (0, ""), (1, None), (2, "one two"), (3, base), (4, base), (5, " ".join(near)), (6, base.replace(" ", "  ")), (7, long), (8, long + " tail"),
        (9, "x" * 5000), (10, "x" * 300), (11, "ab " * 2000), (12, "Ünïcödé ß 中文 🙂 " * 30), (12, "Ünïcödé ß 中文 🙂 " * 30), (12, "other text under the same number"),
        (None, base), (None, None), (13, "\n\n\n"), (14, "  \t "), (15, "one two"), (16, prose(3, 60)), (17, prose(3, 60) + "\nand a new line of words at the end"),
        (18, "<|endoftext|> mid <|endoftext|>"), (19, "word"), (20, "WORD"),
    ]
    return [(i, t, ("en", None)[k % 5 == 0], ("a", "b", None)[k % 3], None, "clash", 5, 6, 7, 0.5, 1) for k, (i, t) in enumerate(texts)]


def table(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
