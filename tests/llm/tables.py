"""Small tables for the tests, with the cases that every operator must define a result for."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"
LABELS = "doc_id long, quality int, toxic int"
WORDS = [f"{a}{b}" for a in ("ba", "ko", "mi", "ren", "sol", "tu", "vex") for b in ("an", "ed", "il", "or", "um", "ys", "ta")]


def prose(seed: int, n: int = 60) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def docs(spark, rows):
    """rows: (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCS)


def edge_rows():
    """Null, empty and blank texts, a null id, repeated rows, a long text, nulls in the other columns."""
    long = prose(99, 40_000)
    return [(1, prose(1)), (2, None), (3, ""), (4, " \n\t "), (None, prose(2)), (5, prose(3)), (5, prose(3)), (6, long), (7, prose(1)), (8, prose(8), None, None), (9, "x")]


def clashing(df):
    """df with columns named like those that the operators make."""
    from pyspark.sql import functions as F

    names = ("fp", "score", "component_id", "size", "taken", "copies", "kept", "k", "rn", "fingerprint", "n_words", "w", "s", "e", "b", "g", "p", "d", "i", "l", "host", "path", "digest", "item_id", "coverage", "n_items", "quality", "toxic")
    return df.select("*", *[F.lit(7).alias(n) for n in names if n not in df.columns])


ODD = ("a.b", "Size", "TAKEN", "__ls_fp", "__ls_row", "__m_id", "__c_row", "__q_w", "__dc_own", "__row", "x`y", "c0", "C7", "with space", "ö")


def odd_names(df):
    """df with columns whose names need quotes, differ in case from those that the operators make, or are used inside them."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(k).alias(n) for k, n in enumerate(ODD)])
