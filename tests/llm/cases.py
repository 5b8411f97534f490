"""Documents with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, size int, rank int, __n int"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


def rows(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    body = words(rng, 60)
    texts = [words(rng, 40) for _ in range(12)] + [body] * 5 + [body + " tail", "", " \n\t ", None, "one", "two words", "Ünï cödé ☃ \U0001f389 漢字", words(rng, 30_000)]
    out = [(i, t, "en" if i % 3 else None, None if i % 7 == 0 else f"s{i % 3}", None if t is None else len(t), "x", i, 0, 1) for i, t in enumerate(texts)]
    out += [out[0], out[0], (None, "no id here", "en", "s1", 10, "x", 1, 1, 1), (None, None, None, None, None, None, None, None, None)]
    return out


def frame(spark, seed: int = 1):
    return spark.createDataFrame(rows(seed), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
