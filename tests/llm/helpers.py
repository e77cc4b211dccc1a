"""Awkward documents that every operator of the subpackage has to take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, start long, kept boolean"
LONG = " ".join(f"w{k % 977}x" for k in range(60_000))


def awkward(extra=()):
    texts = [
        (1, "One two three four five six seven."), (2, None), (3, ""), (4, "   \n \t "), (None, "no key at all"), (5, "twice"), (5, "twice"),
        (6, "twice other"), (None, None), (-7, "Ünï  cödé text x\x1cy é don't  \n\n stop 12345 \U0001f600!"), (8, LONG), (9, "tail  "), *extra,
    ]
    return [(i, t, "en", "s", len(t) if t is not None else None, 0.5, 1, True) for i, t in texts]


def frame(spark, rows=None, extra=()):
    return spark.createDataFrame(awkward(extra) if rows is None else rows, SCHEMA)
