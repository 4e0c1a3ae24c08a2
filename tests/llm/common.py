"""Small tables that every operator must take: nulls, empties, ties, repeats, clashing extra columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, size long, name string, `group` int"


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(n=120, seed=1):
    """Rows of DOCS: plain, empty, null, copies, near copies, long, odd white space, repeated rows."""
    rng = random.Random(seed)
    texts = [words(rng, rng.randint(1, 120)) for _ in range(n)]
    for k in range(0, n, 6):
        w = texts[k].split()
        if len(w) > 12:
            w[rng.randrange(len(w))] = "ZZ"
            texts[(k + 1) % n] = "  ".join(w).upper()
    texts[3], texts[4], texts[5], texts[7] = "", None, " \t\n\x0b\f\r ", texts[0]
    texts[9] = words(rng, 6000)
    texts[10], texts[11] = "one", "12 34 --"
    rows = [(i, t, rng.choice(["de", "en", None]), rng.choice(["a", "b", "c", None]), None if t is None else len(t), "x", 1, "y", 0) for i, t in enumerate(texts)]
    return rows + [rows[0], rows[0], (None, texts[20], "en", "a", 1, "x", 1, "y", 0)]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)
