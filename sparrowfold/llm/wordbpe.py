"""Whole texts to ids by a tokenizers file, with a bounded store of pieces that were encoded before.

The file's normalizer and splitter never look across a blank or a line feed, so a text's ids are the ids of its
blank-free pieces in a row. Only pieces not met before go to the library.
"""

from __future__ import annotations

import os
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import held

#: Pieces, and words without their punctuation, that a worker keeps; beyond it they are encoded anew in each slice of texts.
KEEP_PIECES, KEEP_WORDS = 100_000, 300_000
#: The same where other operators have left little memory.
LEAN_PIECES, LEAN_WORDS, LEAN_SLICE = 0, 20_000, 1_000_000
#: Characters that the splitter always parts from letters and that take no part in contractions.
TAILS = ".,;:!?%*#$&|"


class WordEncoder:
    def __init__(self, path: str, pieces: int | None = None, words: int | None = None):
        self.keep_pieces, self.keep_words = KEEP_PIECES if pieces is None else pieces, KEEP_WORDS if words is None else words
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values()) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        # ids that end a word: with the suffix, a run of letters has exactly one of them, its last
        self.ends = np.zeros(size, bool)
        self.ends[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self.kept: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {"": b""}

    def _whole(self, pieces: list[str]) -> dict[str, bytes]:
        """Each piece by itself."""
        out = {}
        for at in range(0, len(pieces), 20_000):
            part = pieces[at : at + 20_000]
            for piece, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                out[piece] = np.array(e.ids, dtype=self.dtype).tobytes()
        return out

    def _letters(self, words: list[str]) -> dict[str, bytes]:
        """Runs of letters, many in one call, parted where a word ends."""
        out = {}
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=self.dtype)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part) or (len(stops) and stops[-1] != len(ids)):
                out.update(self._whole(part))
                continue
            raw, width = ids.tobytes(), self.dtype.itemsize
            bounds = [0, *(stops * width).tolist()]
            out.update((w, raw[a:b]) for w, a, b in zip(part, bounds, bounds[1:]))
        return out

    def _fresh(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces: letters followed by punctuation are put together from the two; others are encoded whole."""
        words, parted, other, lacking, tails = self.words, [], [], set(), set()
        for k, piece in enumerate(pieces):
            word = piece.rstrip(TAILS)
            if word == "" or (word.isalpha() and (word.isascii() or normalize("NFC", word).lower().isalpha())):
                tail = piece[len(word) :]
                # only ASCII is folded here: elsewhere, lower case can depend on what stands beside
                word = word.lower() if word.isascii() else word
                parted.append((k, word, tail))
                if word not in words:
                    lacking.add(word)
                if tail not in words:
                    tails.add(tail)
            else:
                other.append(k)
        known = self._letters(list(lacking))
        if len(words) < self.keep_words:
            words.update(known)
        known |= self._whole(list(tails))
        get = {**words, **known}.get if len(known) > len(words) else lambda w: known.get(w) if w in known else words[w]
        out: list[bytes] = [b""] * len(pieces)
        for k, word, tail in parted:
            out[k] = get(word) + get(tail) if tail else get(word)
        for k, ids in zip(other, self._whole([pieces[k] for k in other]).values()):
            out[k] = ids
        return out

    def _coded(self, pieces: list[str]) -> list[bytes]:
        """The ids of each distinct piece."""
        kept = self.kept
        out = list(map(kept.get, pieces))
        at = [k for k, x in enumerate(out) if x is None]
        fresh = self._fresh([pieces[k] for k in at])
        for k, ids in zip(at, fresh):
            out[k] = ids
        if len(kept) < self.keep_pieces:
            kept.update(zip([pieces[k] for k in at], fresh))
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin, with the end of the last; null and empty texts
        have none. Pieces are found and told apart by Arrow, and their ids put together by offsets."""
        parts = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        first = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        coded = parts.flatten().dictionary_encode()
        which, ids = coded.indices.to_numpy(zero_copy_only=False), self._coded(coded.dictionary.to_pylist())
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        pool, start = np.frombuffer(b"".join(ids), self.dtype), np.cumsum(length) - length
        n = length[which]
        stop = np.cumsum(n)
        # places within the pool: 4 bytes each, unless one text alone has more than 2 ** 31 ids
        kind = np.int32 if stop[-1:].sum() < 1 << 31 else np.int64
        take = np.repeat((start[which] - (stop - n)).astype(kind), n)
        take += np.arange(len(take), dtype=kind)
        return pool[take], np.concatenate([[0], stop])[first]

    def encode_ended(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As encode(), with end_id after each text's ids."""
        ids, bounds = self.encode(texts)
        bounds = bounds + np.arange(len(bounds))
        out = np.empty(len(ids) + len(texts), self.dtype)
        own = np.ones(len(out), bool)
        own[bounds[1:] - 1] = False
        out[own], out[~own] = ids, end_id
        return out, bounds


def encoder(path: str, lean: bool = False) -> WordEncoder:
    """One encoder a worker process and file; a lean one keeps less and takes longer."""
    return held(("words", path, lean), lambda: WordEncoder(path, *((LEAN_PIECES, LEAN_WORDS) if lean else ())))


def slices(batch, column: str = "text", size: int = 8_000_000):
    """(first row, Arrow array of texts) of a batch, cut so that a slice's bytes are bounded unless one text alone is longer."""
    texts = batch.column(column)
    if not len(texts):
        return
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + size, "right")))
        yield start, texts.slice(start, end - start)
        # Arrow's allocator keeps what a slice took; executors have little memory beside the JVM's
        pa.default_memory_pool().release_unused()
        start = end


def text_slices(batch, column: str = "text", chars: int = 4_000_000):
    """(first row, texts) of an Arrow batch, cut so that a slice's texts are bounded unless one text alone is longer."""
    texts = batch.column(column).to_pylist()
    start, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= chars:
            yield start, texts[start : k + 1]
            start, size = k + 1, 0
    if start < len(texts):
        yield start, texts[start:]
