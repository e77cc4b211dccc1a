import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparrowfold.llm.common import Workspace
from sparrowfold.llm.packing import binary_lengths, pack
from sparrowfold.llm.token_store import PerfectHash, TokenStore, fingerprint, ids_crc32
from sparrowfold.llm.wordbpe import WordEncoder

from .helpers import awkward, frame

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows, end):
    t = Tokenizer.from_file(PATH)
    return [(i, t.encode(x or "", add_special_tokens=False).ids + [end]) for i, x, *_ in rows]


def test_encoder_agrees_with_the_library():
    """Odd letters too: some grow marks when lower-cased or composed, and may not be taken for one word."""
    rng = random.Random(1)
    alphabet = "ab THE'sé日\n\t 0123!.,;:%*\x1c\x85\u3000ßİǅſ\u0301-|$&#?\u0958\u1112\u1161\u212a"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)] + [None, "", " ", "İ ſ İ* a", "İ" * 50]
    ids, bounds = WordEncoder(PATH).encode(pa.array(texts))
    assert [(k, ids[a:b].tolist()) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))] == list(enumerate(x[:-1] for _, x in expected([(0, t) for t in texts], 0)))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_store_holds_whole_texts(spark):
    rows = awkward()
    store = TokenStore.write(frame(spark), PATH, 2, Workspace(spark, "t"))
    got = store.get(frame(spark)).withColumn("crc", ids_crc32("ids", "width")).orderBy("start").collect()
    want = sorted(expected(rows, 2), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r.doc_id for r in got] == [i for i, _ in want]
    assert Counter((r.doc_id, r.n_tokens, r.crc) for r in got) == Counter((i, len(x), crc(x)) for i, x in want)
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got[:-1]]))


def test_store_lookup_of_unknown_keys(spark):
    store = TokenStore.write(frame(spark), PATH, 2, Workspace(spark, "t"))
    got = store.get(spark.createDataFrame([(5,), (777,), (-7,), (123456,)], "doc_id long")).collect()
    assert sorted(r.doc_id for r in got) == [-7, 5, 5]


def test_store_of_nothing(spark):
    store = TokenStore.write(frame(spark, []), PATH, 2, Workspace(spark, "t"))
    assert store.get(frame(spark)).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 50_000))
    mph = PerfectHash.build(keys)
    assert sorted(mph.number(keys)) == list(range(len(keys)))
    again = PerfectHash.load(**mph.dump())
    assert (again.number(keys) == mph.number(keys)).all()
    assert len(np.unique(fingerprint(keys))) > 49_000


@pytest.mark.parametrize("n", [1, 2, 3, 2047, 2048, 2049, 10_000])
def test_binary_lengths(n):
    parts = binary_lengths(n)
    assert sum(parts) == n and all(p & (p - 1) == 0 and p <= 2048 for p in parts)
    assert max(Counter(p for p in parts if p < 2048).values(), default=1) == 1


def test_packing_round_trip(spark):
    got = pack(frame(spark), PATH, 1).collect()
    want = Counter((i, tuple(x)) for i, x in expected(awkward(), 1))
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    assert all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.ids_crc32 == zlib.crc32(r.ids) for r in got)
    by = sorted(got, key=lambda r: r.sequence_id)
    assert [r.length for r in by] == sorted((r.length for r in got), reverse=True)
    singles = {i for i, n in Counter(i for i, *_ in awkward()).items() if n == 1}
    for key in singles:
        own = sorted((r for r in got if r.doc_id == key), key=lambda r: r.start)
        ids = tuple(x for r in own for x in np.frombuffer(r.ids, "<u4").tolist())
        assert (key, ids) in want and len(ids) == own[0].doc_tokens
    assert pack(frame(spark, []), PATH, 1).count() == 0


def test_a_lost_index_file_is_an_error(spark):
    ws = Workspace(spark, "t")
    store = TokenStore.write(frame(spark), PATH, 2, ws)
    ws.drop("index/bucket-000000.mph")
    with pytest.raises(Exception, match="bucket-000000|No such file|FileNotFound"):
        store.get(frame(spark)).collect()
    # the bucket of nulls is another one
    assert store.get(spark.createDataFrame([(None,)], "doc_id long")).count() == 2


def test_one_key_over_several_shards(spark):
    rows = [(7, f"text {k}") for k in range(300)] + [(k, f"other {k}") for k in range(-20, 20) if k != 7]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    store = TokenStore.write(docs, PATH, 2, Workspace(spark, "t"))
    assert len(store.shards) > 1 and (store.shards["docs"] < 300).all()
    got = store.get(docs).orderBy("start").collect()
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got[:-1]])) and [r.doc_id for r in got] == sorted(i for i, _ in rows)
    width = {2: "<u2", 4: "<u4"}
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, width[r.width]).tolist())) for r in got) == Counter((i, tuple(x)) for i, x in expected(rows, 2))
