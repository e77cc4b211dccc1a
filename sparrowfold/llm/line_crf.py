"""Quality rules over whole texts, and a linear-chain conditional random field that marks lines as content or boilerplate.

No table says which lines are boilerplate. The field's teacher knows what the field doesn't see: a line is boilerplate
if its document is labelled as of low quality, or if far more documents hold it than hold its document's other lines
(counted over all documents). From that the field learns what such lines look like, by features of a line and of what
stands beside it, and marks lines of any document. Viterbi decoding marks the lines; the share of words in content
lines decides whether a document is kept.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
SYMBOLS = b"#*$%&|<>"
NOTICES = (b"all rights reserved", b"copyright", b"licensed under", b"license", b"cookie", b"subscribe", b"terms of use", b"privacy policy", b"click here", b"http://", b"https://", "©".encode())
CONTENT, BOILERPLATE = 0, 1
#: The training sample: labelled documents of the least hash of doc_id, and a run of so many lines of each.
SAMPLE_DOCUMENTS, SAMPLE_LINES = 1200, 40
#: A line is a shared one if so many documents hold it, and so many times as many as hold its run's median line.
SHARED_DOCUMENTS, SHARED_TIMES = 5, 4
#: A document is kept if content lines hold this share of its words.
LEAST_CONTENT = 0.5

FEATURES = ("always", "one_word", "few_words", "many_words", "some_symbols", "symbols", "capitals", "bars", "repeated_line", "repeated_words", "sentence_end", "digits", "notice", "first", "last")
_BIT = {name: 1 << k for k, name in enumerate(FEATURES)}
_NOT_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)
_CAPITAL = re.compile(r"[^\W\d_]")


def line_bits(lines: list[bytes], words: list[list[bytes]]) -> np.ndarray:
    """A bit mask of FEATURES for each line; repeated_line marks lines equal to an earlier one."""
    seen: set[bytes] = set()
    out = np.zeros(len(lines), np.int64)
    b = _BIT
    for k, (line, own) in enumerate(zip(lines, words)):
        n = len(own)
        x = b["always"]
        x |= b["one_word"] if n == 1 else b["few_words"] if n <= 4 else b["many_words"] if n >= 12 else 0
        symbols = len(line.translate(None, _NOT_SYMBOL))
        x |= b["symbols"] if symbols >= 0.5 * n else b["some_symbols"] if symbols else 0
        if line.count(b"|") >= 3:
            x |= b["bars"]
        text = line.decode("utf-8", "surrogatepass")
        if text.upper() == text and n >= 2 and _CAPITAL.search(text):
            x |= b["capitals"]
        if line in seen:
            x |= b["repeated_line"]
        seen.add(line)
        if n >= 8 and len(set(own)) < 0.4 * n:
            x |= b["repeated_words"]
        if own[-1][-1:] in b".!?:;,":
            x |= b["sentence_end"]
        if sum(w[:1].isdigit() for w in own) > 0.3 * n:
            x |= b["digits"]
        low = line.lower()
        if any(w in low for w in NOTICES):
            x |= b["notice"]
        out[k] = x
    if len(out):
        out[0] |= b["first"]
        out[-1] |= b["last"]
    return out


def rule_labels(bits: np.ndarray) -> np.ndarray:
    """The teacher where no document is labelled: boilerplate if a line is junk by itself, repeats an earlier line, or is a notice."""
    has = lambda *names: np.any([bits & _BIT[n] != 0 for n in names], axis=0)
    junk = has("symbols", "bars", "capitals", "repeated_words", "notice", "repeated_line")
    bare = has("one_word", "few_words") & ~has("sentence_end") & has("digits")
    return (junk | bare).astype(np.int64)


def as_matrix(bits: np.ndarray) -> np.ndarray:
    return (bits[:, None] >> np.arange(len(FEATURES)) & 1).astype(np.float64)


def train(documents: list[tuple[np.ndarray, np.ndarray]], steps: int = 100, rate: float = 0.3, penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x 2) and transitions (2 x 2) of the field by Adam on the mean log-likelihood of the sequences
    (bit masks, labels). Without a line, all are 0, and so every line is content."""
    width = len(FEATURES)
    theta = np.zeros(2 * width + 4)
    documents = sorted((d for d in documents if len(d[0])), key=lambda d: -len(d[0]))
    if not documents:
        return theta[: 2 * width].reshape(width, 2), theta[2 * width :].reshape(2, 2)
    kinds, kind = np.unique(np.concatenate([d[0] for d in documents]), return_inverse=True)
    x, y = as_matrix(kinds), np.concatenate([d[1] for d in documents])
    lengths = np.array([len(d[0]) for d in documents])
    last = np.cumsum(lengths) - 1
    first = last - lengths + 1
    owner = np.repeat(np.arange(len(lengths)), lengths)
    before = np.setdiff1d(np.arange(len(y)), last)
    after = before + 1
    # the k-th lines of the documents that have one: the longest come first
    at = [first[: np.searchsorted(-lengths, -k, "left")] + k for k in range(lengths[0])]
    tally = lambda p: np.stack([np.bincount(kind, weights=p[:, c], minlength=len(kinds)) for c in (0, 1)], 1)
    observed = np.zeros((2, 2))
    np.add.at(observed, (y[before], y[after]), 1)
    gold = np.concatenate([(x.T @ tally(np.eye(2)[y])).ravel(), observed.ravel()])
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, t = theta[: 2 * width].reshape(width, 2), theta[2 * width :].reshape(2, 2)
        e = (x @ w)[kind]
        fore, back = e.copy(), np.zeros_like(e)
        for rows in at[1:]:
            for c in (0, 1):
                fore[rows, c] += np.logaddexp(fore[rows - 1, 0] + t[0, c], fore[rows - 1, 1] + t[1, c])
        for rows in reversed(at[1:]):
            for c in (0, 1):
                back[rows - 1, c] = np.logaddexp(t[c, 0] + e[rows, 0] + back[rows, 0], t[c, 1] + e[rows, 1] + back[rows, 1])
        z = np.logaddexp(fore[last, 0], fore[last, 1])[owner]
        p = np.exp(fore + back - z[:, None])
        pairs = np.exp(fore[before][:, :, None] + t + (e + back)[after][:, None, :] - z[before][:, None, None])
        expected = np.concatenate([(x.T @ tally(p)).ravel(), pairs.sum(0).ravel()])
        grad = (gold - expected) / len(y) - penalty * theta
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        theta = theta + rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return theta[: 2 * width].reshape(width, 2), theta[2 * width :].reshape(2, 2)


def viterbi(emissions: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """The most probable labels of a line sequence; on a tie, content."""
    (t00, t01), (t10, t11) = transitions.tolist()
    rows = emissions.tolist()
    if not rows:
        return np.zeros(0, np.int64)
    a, b = rows[0]
    came = []
    for e0, e1 in rows[1:]:
        from_a, from_b = a + t00 >= b + t10, a + t01 >= b + t11
        came.append((0 if from_a else 1, 0 if from_b else 1))
        a, b = (a + t00 if from_a else b + t10) + e0, (a + t01 if from_b else b + t11) + e1
    label = 0 if a >= b else 1
    out = [label]
    for back in reversed(came):
        label = back[label]
        out.append(label)
    return np.array(out[::-1])


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a 3-word window that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    code = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    size = len(ids)
    _, first = np.unique(code[:-2] * size + code[1:-1], return_inverse=True)
    _, window, count = np.unique(first * size + code[2:], return_inverse=True, return_counts=True)
    often = count[window] > 1
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : k + n - 2] |= often
    return int(hit.sum())


def lines_of(raw: bytes) -> tuple[list[bytes], list[list[bytes]]]:
    """The lines that hold a word, and each one's words. bytes.split() parts at blanks and the characters 9 to 13 only."""
    pairs = [(line, own) for line in raw.split(b"\n") if (own := line.split())]
    return [p[0] for p in pairs], [p[1] for p in pairs]


def rules(text: str | None, model) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content share, of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    lines, words = lines_of(raw)
    flat = [w for own in words for w in own]
    joined = b"".join(flat)
    # code points: bytes that don't continue a character
    chars = len(joined) if joined.isascii() else int(((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80).sum())
    symbols = len(raw.translate(None, _NOT_SYMBOL))
    again = repeated_words(flat)
    failed = len(flat) < 50 or 100 * again > 50 * len(flat)
    share = 0.0
    if flat:
        label = viterbi(as_matrix(line_bits(lines, words)) @ model[0], model[1])
        sizes = np.array([len(own) for own in words])
        share = float(sizes[label == CONTENT].sum() / sizes.sum())
    return len(flat), chars, symbols, len(lines) - len(set(lines)), again, failed, not failed and share >= LEAST_CONTENT, share


def taught(bits: np.ndarray, held: np.ndarray, poor: bool) -> np.ndarray:
    """The teacher's labels of a run of lines: held says how many documents hold each, poor that the document is of low quality."""
    if poor or not len(held):
        return np.full(len(bits), BOILERPLATE)
    median = np.sort(held)[(len(held) - 1) // 2]
    return np.where((held >= SHARED_DOCUMENTS) & (held >= SHARED_TIMES * median), BOILERPLATE, CONTENT)


def fit(docs: DataFrame, labels: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Trains on a run of SAMPLE_LINES lines of each of at most SAMPLE_DOCUMENTS documents that labels (doc_id, label
    1 for good) covers, those of the least hash of doc_id, then text; without labelled documents on any, taught by
    rule_labels(). Only bit masks and keys of lines come to the driver; how many documents hold a line is counted over
    all documents. Null doc_ids are not learnt from; labels of a repeated doc_id are averaged.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    ranks = [F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("g")]
    given = None
    if labels is not None:
        given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("double").alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg((F.avg("y") < 0.5).alias("poor"))
        keyed = rows.select("doc_id", *ranks).join(given, "doc_id")
        if keyed.isEmpty():
            given = None
    if given is None:
        keyed = rows.select("doc_id", *ranks, F.lit(False).alias("poor"))
    sample = keyed.distinct().orderBy("h", "g").limit(SAMPLE_DOCUMENTS).collect()
    if not sample:
        return train([])
    poor = {(r.h, r.g): r.poor for r in sample}
    chosen = rows.join(F.broadcast(spark.createDataFrame([(h, g) for h, g in poor], "h long, g long")), [F.xxhash64("doc_id") == F.col("h"), F.xxhash64("text") == F.col("g")]).select("h", "g", "text")

    def runs(batches):
        import xxhash

        for batch in batches:
            out = []
            for h, g, text in zip(batch.column("h").to_pylist(), batch.column("g").to_pylist(), batch.column("text")):
                lines, words = lines_of((text.as_py() or "").encode("utf-8", "surrogatepass"))
                start = h % max(1, len(lines) - SAMPLE_LINES + 1)
                part = slice(start, start + SAMPLE_LINES)
                out.append((h, g, line_bits(lines, words)[part].tolist(), [xxhash.xxh64_intdigest(x) - (1 << 63) for x in lines[part]]))
            columns = list(zip(*out)) or [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["h", "g", "bits", "keys"])

    found = {(r.h, r.g): r for r in chosen.mapInArrow(runs, "h long, g long, bits array<bigint>, keys array<bigint>").dropDuplicates(["h", "g"]).collect()}
    if given is None:
        return train([(b := np.array(found[k].bits, np.int64), rule_labels(b)) for k in sorted(found)])
    wanted = spark.sparkContext.broadcast({x for r in found.values() for x in r["keys"]})  # at most SAMPLE_DOCUMENTS * SAMPLE_LINES

    def holders(batches):
        import xxhash

        count: dict[int, int] = {}
        for batch in batches:
            for text in batch.column("text"):
                own = {xxhash.xxh64_intdigest(x) - (1 << 63) for x in (text.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n") if x}
                for key in own & wanted.value:
                    count[key] = count.get(key, 0) + 1
        yield pa.RecordBatch.from_pydict({"key": pa.array(count.keys(), pa.int64()), "n": pa.array(count.values(), pa.int64())})

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(holders, "key long, n long")
    held = {r.key: r.n for r in counted.groupBy("key").agg(F.sum("n").alias("n")).collect()}  # a row a line of the sample
    wanted.unpersist()
    rows = [(np.array(r.bits, np.int64), np.array([held.get(x, 1) for x in r["keys"]]), poor[k]) for k, r in sorted(found.items())]
    return train([(bits, taught(bits, n, bad)) for bits, n, bad in rows])


def judge(docs: DataFrame, labels: DataFrame | None = None, model=None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share of every document.

    Null and empty texts have no words: base_failed, not kept, share 0. A share of exactly LEAST_CONTENT is kept, and a
    line of equally probable labels is content. Null and repeated doc_ids give a row each. Texts of any length and
    number of lines are read whole. Other columns are not read. A table without rows gives none.
    """
    model = fit(docs, labels) if model is None else model
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]

    def run(batches):
        for batch in batches:
            got = list(zip(*(rules(t.as_py(), model) for t in batch.column("text")))) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(got, kinds))], names=["doc_id", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double")
