"""Small corpora with what operators have to stand: nulls, empty and long texts, repeated rows, clashing extra columns."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, _fp string, _p string, `Value` string, kept string, h string, component_id string"


def documents(spark, rows):
    """rows: (doc_id, text, lang)."""
    return spark.createDataFrame([(i, t, g, "s", len(t) if t else None, "x", "y", "z", "v", "k", "h", "c") for i, t, g in rows], SCHEMA)


def prose(seed, n, words="the of and red blue green stone river house cloud walk run sing never often under over light dark sea"):
    rng = random.Random(seed)
    return " ".join(rng.choice(words.split()) + rng.choice(["", "er", "ing", "ed"]) for _ in range(n))


AWKWARD = [(1, None, None), (2, "", "en"), (3, " \n\t ", None), (4, "one", "en"), (4, "one", "en"), (None, "no id here at all", None), (5, "x" * 200_000, "en"), (6, prose(1, 40_000), "en"), (7, "é\U0001f642 <|endoftext|>  double  blank\x85\x1c", "fr")]


def save(spark, path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)
