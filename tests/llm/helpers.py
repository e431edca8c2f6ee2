"""Small tables with the cases that every operator has to take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, more=""):
    """Documents with the given texts; `more` adds columns with names that operators use themselves."""
    rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in enumerate(texts)]
    names = [c for c in more.split() if c]
    schema = DOCS + "".join(f", {c} string" for c in names)
    return spark.createDataFrame([(*r, *(["mine"] * len(names))) for r in rows], schema)


def prose(rng: random.Random, n: int, words=400) -> str:
    vocabulary = [f"w{k}" for k in range(words)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


EDGE = [None, "", " \n\t ", "a", "é", "\n\n", "word " * 5000, "x" * 50_000, "a\x00b", "漢字 かな 😀 ﷽", "a\r\nb\r\n\r\nc"]
