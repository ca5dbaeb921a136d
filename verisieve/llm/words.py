"""Batches of texts as arrays of word codes.

Everything here works on whole Arrow batches: splitting, lower-casing and
coding run in compiled code, and only the distinct words of a batch are ever
touched by Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


class Words:
    """Words of a batch: ``codes[offsets[i]:offsets[i + 1]]`` index ``vocab``."""

    def __init__(self, codes: np.ndarray, offsets: np.ndarray, vocab: list[str]):
        self.codes, self.offsets, self.vocab = codes, offsets, vocab

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def owners(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, end to end, and where each begins; null texts are empty."""
    t = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])
    offsets = np.frombuffer(t.buffers()[1], np.int64, len(t) + 1, t.offset * 8)
    data = np.frombuffer(t.buffers()[2], np.uint8) if t.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: ASCII between words, and marks among it; bytes of other characters stand as they are, and "_" belongs to words where marks are kept.
_BLANKS = [b for b in range(128) if chr(b).isspace()]
_MARKS = [b for b in range(128) if not chr(b).isalnum() and b not in _BLANKS and chr(b) != "_"]
_LOWER = [b if b >= 128 else ord(chr(b).lower()) for b in range(256)]
_WITH_MARKS = bytes(32 if b in _BLANKS else _LOWER[b] for b in range(256))
_WORDS_ALONE = bytes(32 if b in _BLANKS or b in _MARKS or b == ord("_") else _LOWER[b] for b in range(256))
_IN_WORD = bytes(b not in _BLANKS and b not in _MARKS for b in range(256))


def split(texts: pa.Array, keep_marks: bool = False) -> Words:
    """Lower-cased words of each text; a null text has none.

    keep_marks: punctuation marks count as words of their own.

    Words are told apart by bytes; only distinct ones with other characters
    than ASCII are read by the classes of their characters.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    data, bounds = text_bytes(texts)
    mapped = data.tobytes().translate(_WITH_MARKS if keep_marks else _WORDS_ALONE)
    letters = np.frombuffer(mapped.translate(None, b" "), np.uint8)
    inside = np.frombuffer(mapped, np.uint8) != 32
    of_word = np.frombuffer(mapped.translate(_IN_WORD), bool) if keep_marks else inside
    # Whether a word goes on with the next byte.
    on = of_word[:-1] & of_word[1:]
    begins = bounds[(bounds > 0) & (bounds < len(data))]
    on[begins - 1] = False
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~on
    last[:-1] &= ~on
    start = np.flatnonzero(first)
    offsets = np.searchsorted(start, bounds).astype(np.int64)
    # Where each word begins among the letters alone.
    spans = np.concatenate([[0], np.cumsum(np.flatnonzero(last) + 1 - start)]).astype(np.int64)
    coded = pc.dictionary_encode(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(spans), pa.py_buffer(letters)]))
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    found = coded.dictionary.cast(pa.large_string())
    vocab = found.to_pylist()
    other = np.flatnonzero(~pc.string_is_ascii(found).to_numpy(zero_copy_only=False).astype(bool))
    if not len(other):
        return Words(codes, offsets, vocab)
    odd = pc.utf8_lower(found.take(pa.array(other)))
    odd = pc.replace_substring_regex(odd, r"([^\pL\pN\pM\s_])", r" \1 ") if keep_marks else pc.replace_substring_regex(odd, r"[^\pL\pN\pM]+", " ")
    count, flat, done = np.ones(len(vocab), np.int64), [], 0
    for k, x in zip(other.tolist(), odd.to_pylist()):
        parts = x.split()
        flat += [*vocab[done:k], *parts]
        count[k], done = len(parts), k + 1
    flat += vocab[done:]
    # Words are numbered in the order in which they come first.
    code_of = {x: i for i, x in enumerate(dict.fromkeys(flat))}
    code = np.fromiter((code_of[x] for x in flat), np.int64, len(flat))
    if (count == 1).all():
        return Words(code[codes], offsets, list(code_of))
    times = count[codes]
    ends = np.cumsum(times)
    where = np.repeat((np.cumsum(count) - count)[codes] - (ends - times), times) + np.arange(times.sum())
    return Words(code[where], np.concatenate([[0], ends])[offsets], list(code_of))


def distinct_words(words: Words, cells: int = 1 << 25) -> tuple[np.ndarray, np.ndarray]:
    """(text, code) of each distinct word of each text, in order; marked in tables of at most ``cells`` places, some texts at a time."""
    n, size = len(words.offsets) - 1, max(1, len(words.vocab))
    owner, rows = words.owners(), max(1, cells // size)
    out = []
    for a in range(0, n, rows):
        z = min(n, a + rows)
        seen = np.zeros((z - a) * size, bool)
        part = slice(words.offsets[a], words.offsets[z])
        seen[(owner[part] - a) * size + words.codes[part]] = True
        out.append(np.flatnonzero(seen) + a * size)
    flat = np.concatenate(out) if out else np.zeros(0, np.int64)
    return flat // size, flat % size


def hashes(vocab: list[str]) -> np.ndarray:
    """A stable 64-bit hash of each word."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocab), np.uint64, len(vocab))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finaliser of a 64-bit hash; differs by ``salt``."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)).astype(np.uint64)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, and the text of each.

    A text of fewer words yields one shingle of all its words, an empty one
    none.
    """
    h = hashes(words.vocab)[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    n, owner = len(h), words.owners()
    end = np.minimum(words.offsets[1:][owner], n) if n else np.zeros(0, np.int64)
    pos = np.arange(n)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            at = pos + k
            inside = at < end
            out = out * np.uint64(0x100000001B3) + np.where(inside, h[np.minimum(at, max(n - 1, 0))] if n else 0, np.uint64(k + 1))
    start = words.offsets[:-1][owner] if n else np.zeros(0, np.int64)
    keep = (pos + width <= end) | (pos == start) & (end - start < width)
    return mix(out[keep]), owner[keep]


class Counts:
    """Hashes of words or terms in order with the texts that have them, among ``total``."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, total: int):
        order = np.argsort(keys)
        self.keys, self.n, self.total = keys[order], n[order], total

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.n[at], 0).astype(float)
