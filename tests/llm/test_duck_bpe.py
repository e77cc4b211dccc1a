import hashlib
import random

import public_tokenizers
import pyarrow as pa
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sparrowfold.llm.duck_bpe import DuckBPE, code, read_ranks

from .helpers import awkward, frame

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ENCODING = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})
CODER = DuckBPE(PATH, public_tokenizers.PATTERN)
ODD = ["a  \nb", "  x", " a ", "it's  we'll\t\n z 12345 ÄÖ日本語 \x1c y", "x" * 500, "ab" * 80 + " cd", "aaaa" * 10 + " b", "\n\n", "日本語" * 60, "<|endoftext|>", "a  b", "a  b"]


def plain(text):
    return " ".join(map(str, ENCODING.encode_ordinary(text))).encode(), text.encode()


def coded(texts, coder=CODER):
    return coder.code_batch(pa.array(texts, pa.string()))


def test_odd_texts():
    assert coded(ODD) == [plain(t) for t in ODD]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abtheing 'sé日\n\t0123!.\x1c\x85\u3000\0"), max_size=60), min_size=1, max_size=20))
def test_any_texts(texts):
    assert coded(texts) == [plain(t) for t in texts]


def test_long_pieces():
    """All occurrences of a pair at once: runs, pieces of 10,000 bytes, tokens that are sides of earlier merges."""
    rng = random.Random(4)
    parts = ["in", "g", "th", "e", "er", "the", "s", "ss", "n", "tion", "aa"]
    long = ["ab" * 5000, "x" * 10_000, "x" * 4001, "日本語" * 1200, "aab" * 100, "".join(rng.choice("etaoinshrdlu") for _ in range(2000))]
    long += ["".join(rng.choice(parts) for _ in range(rng.randrange(20, 90))) for _ in range(200)]
    assert coded(long) == [plain(t) for t in long]


def test_another_pattern_splits_whole_texts():
    pattern = r"\w+ \w+|\w+|\s+|[^\w\s]+"
    other = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=read_ranks(PATH), special_tokens={})
    texts = ["a b c d", "one two, three four  five", " x y"]
    assert [ids for ids, _ in coded(texts, DuckBPE(PATH, pattern))] == [" ".join(map(str, other.encode_ordinary(t))).encode() for t in texts]


def test_frame(spark):
    got = code(frame(spark), PATH, public_tokenizers.PATTERN, with_ids=True).collect()
    want = sorted((str(i), plain(t or "")) for i, t, *_ in awkward())
    assert sorted((str(r.doc_id), (" ".join(map(str, r.ids)).encode(), bytes(r.decoded))) for r in got) == want
    assert all(r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() and r.n_tokens == len(r.ids) for r in got)
    assert code(frame(spark, []), PATH, public_tokenizers.PATTERN).count() == 0
