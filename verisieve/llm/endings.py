"""How texts end: empty answers, open structures and the terminality of closing words."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stage
from .words import Words, hashes, mix, split, text_bytes

#: Stand-ins for a missing value, letters and digits only (fixed values).
STAND_INS = frozenset(
    "na nan null none nil nul void undefined missing blank empty tbd todo tba noanswer nooutput noresponse noresult notavailable notapplicable "
    "answer finalanswer theanswer theansweris result response output assistant answeranswer imend imstart endoftext eos s pad "
    "antwort ergebnis keine keineantwort leer réponse résultat vide aucune aucuneréponse sansréponse respuesta resultado vacío ninguna sinrespuesta".split()
)
#: Characters of the tail that hold the closing words.
TAIL = 160
#: Bits of a hashed run.
BITS = 44
#: Closing runs that are counted and broadcast at once; more are counted in passes and sent as files.
KEYS = 4_000_000
FAMILIES = 7  # runs of 4, 3, 2 and 1 closing words, runs of 3 before any word, longer words after the word before, longer words
EXT2, EXT1 = 5, 6


def emptied(texts: pa.Array) -> np.ndarray:
    """Texts that no answer could be read from: null, blank, bare marks, stand-ins for a missing value."""
    t = pc.fill_null(texts.cast(pa.large_string()), "")
    short = pc.less(pc.binary_length(t), 60).to_numpy(zero_copy_only=False)
    out = np.zeros(len(t), bool)
    at = np.flatnonzero(short)
    if len(at):
        bare = pc.replace_substring_regex(pc.utf8_lower(t.take(pa.array(at))), r"[^\pL\pN]+", "")
        out[at] = [x == "" or x in STAND_INS for x in bare.to_pylist()]
    at = np.flatnonzero(~short)
    if len(at):
        out[at] = ~pc.match_substring_regex(t.take(pa.array(at)), r"[\pL\pN]").to_numpy(zero_copy_only=False).astype(bool)
    return out


#: Numbers of the marks that come in pairs, each opening one before its closing one, and of ticks.
_PAIRED = bytes(max(0, "{}[]()`".find(chr(b)) + 1) for b in range(256))


def opened(texts: pa.Array) -> np.ndarray:
    """Texts with a bracket, fence or list number that nothing closes, a broken character or an ellipsis at the end."""
    data, offsets = text_bytes(texts)
    n = len(texts)
    kind = np.frombuffer(data.tobytes().translate(_PAIRED), np.uint8)
    at = np.flatnonzero(kind)
    count = np.bincount((np.searchsorted(offsets, at, "right") - 1) * 8 + kind[at], minlength=8 * n).reshape(n, 8)
    odd = (count[:, 1:6:2] > count[:, 2:7:2]).any(1)
    ticks = np.flatnonzero(count[:, 7])
    t = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(ticks):
        odd[ticks] |= pc.count_substring(t.take(pa.array(ticks)), "```").to_numpy(zero_copy_only=False) % 2 == 1
    end = pc.utf8_slice_codeunits(pc.utf8_rtrim_whitespace(t), -24)
    # A list number stands at the start of a line.
    ends = pc.match_substring_regex(end, r"(?:\n\s*(?:\d{1,4}[.)]|[-*])|\x{FFFD}|\x{2026}|\.\.\.|\[\.\.\.\]|[^`]`{1,2})$")
    alone = pc.match_substring_regex(end, r"^\s*(?:\d{1,4}[.)]|[-*])$")
    return odd | ends.to_numpy(zero_copy_only=False).astype(bool) | alone.to_numpy(zero_copy_only=False).astype(bool)


#: States that the closing words may stand in, besides none of them.
STATES = ("bracket", "fence", "item")
_STEP = np.zeros(256, np.int8)
_STEP[[ord(c) for c in "{[("]] = 1
_STEP[[ord(c) for c in "}])"]] = -1
_BRACKET = (_STEP != 0).tobytes()
_ITEM = r"\n\s*(?:\d{1,4}[.)]|[-*])"


def _brackets(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where brackets stand in the bytes, and 1 for each that opens, -1 for each that closes."""
    at = np.flatnonzero(np.frombuffer(data.tobytes().translate(_BRACKET), bool))
    return at, _STEP[data[at]]


def _having(data: np.ndarray, offsets: np.ndarray, byte: str) -> np.ndarray:
    """Texts that have an ASCII character."""
    at = np.flatnonzero(data == ord(byte))
    whose = np.searchsorted(offsets, at, "right") - 1
    return whose[np.append(True, whose[1:] != whose[:-1])] if len(at) else whose


def states(texts: pa.Array) -> np.ndarray:
    """Of each of STATES, whether a text ends in it.

    bracket: one that was opened is not closed yet; fence: a fence of three
    ticks is open; item: a list mark stands alone on its line.
    """
    data, offsets = text_bytes(texts)
    at, step = _brackets(data)
    sums = np.concatenate([[0], np.cumsum(step, dtype=np.int64)])[np.searchsorted(at, offsets)]
    t = pc.fill_null(texts.cast(pa.large_string()), "")
    strip = pc.utf8_slice_codeunits(pc.utf8_rtrim_whitespace(t), -24)
    fence = np.zeros(len(texts), bool)
    ticks = _having(data, offsets, "`")
    fence[ticks] = pc.count_substring(t.take(pa.array(ticks)), "```").to_numpy(zero_copy_only=False) % 2 == 1
    item = pc.match_substring_regex(strip, f"(?:{_ITEM}|^\\s*(?:\\d{{1,4}}[.)]|[-*]))$").to_numpy(zero_copy_only=False).astype(bool)
    return np.stack([sums[1:] > sums[:-1], fence, item])


def goings_on(texts: pa.Array, n: np.ndarray | None = None) -> np.ndarray:
    """How often texts go on in each of STATES: brackets after which one is open, words in fences, list marks with words after them.

    n: how many texts each stands for, one each without it.
    """
    n = np.ones(len(texts), np.int64) if n is None else n
    data, offsets = text_bytes(texts)
    at, step = _brackets(data)
    run = np.concatenate([[0], np.cumsum(step, dtype=np.int64)])
    begin = np.searchsorted(at, offsets)
    brackets, some = np.diff(begin), begin[1:] > begin[:-1]
    open_after = np.concatenate([[0], np.cumsum(run[1:] > np.repeat(run[begin[:-1]], brackets))])
    held = np.diff(open_after[begin])
    # The last bracket of a text goes on nowhere.
    held -= some & (run[begin[1:]] > run[begin[:-1]])
    t = pc.fill_null(texts.cast(pa.large_string()), "")
    ticks = _having(data, offsets, "`")
    fenced = sum(k * len(x.split()) for y, k in zip(t.take(pa.array(ticks)).to_pylist(), n[ticks].tolist()) for x in y.split("```")[1::2])
    lines = _having(data, offsets, "\n")
    items = pc.count_substring_regex(t.take(pa.array(lines)), _ITEM + r"\s+\S").to_numpy(zero_copy_only=False)
    return np.array([held @ n, fenced, items @ n[lines]], np.int64)


def broken_off(texts: pa.Array) -> np.ndarray:
    """Texts that end in a broken character or in a mark that says that more followed."""
    end = pc.utf8_slice_codeunits(pc.utf8_rtrim_whitespace(pc.fill_null(texts.cast(pa.large_string()), "")), -24)
    return pc.match_substring_regex(end, r"(?:\x{FFFD}|\x{2026}|\.\.\.|\[\.\.\.\]|[^`]`{1,2})$").to_numpy(zero_copy_only=False).astype(bool)


def closed(texts: pa.Array) -> np.ndarray:
    """Texts whose last character closes a sentence or structure."""
    end = pc.utf8_slice_codeunits(pc.utf8_rtrim_whitespace(pc.fill_null(texts.cast(pa.large_string()), "")), -1)
    return pc.match_substring_regex(end, r"[.!?}`]").to_numpy(zero_copy_only=False).astype(bool)


def prose(texts: pa.Array) -> pa.Array:
    """Texts with each structured part and each line break as one mark."""
    t = pc.utf8_trim_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    has = pc.match_substring(t, "{")
    if pc.any(has).as_py():
        t = pc.if_else(has, pc.replace_substring_regex(t, r"(?s)\{.*\}", " § "), t)
        t = pc.if_else(pc.match_substring(t, "{"), pc.replace_substring_regex(t, r"(?s)\{.*$", " § "), t)
    return pc.replace_substring(t, "\n", " ¶ ")


def tails(texts: pa.Array) -> pa.Array:
    """The last characters of each text, from a word's start on."""
    t = prose(texts)
    size = pc.utf8_length(t).to_numpy(zero_copy_only=False)
    long = size > TAIL
    cut = pc.utf8_slice_codeunits(t, -TAIL)
    cut = pc.replace_substring_regex(cut, r"^\S+", "")
    return pc.if_else(pa.array(long), cut, t)


def _coded(texts: pa.Array) -> tuple[Words, np.ndarray]:
    w = split(texts, keep_marks=True)
    vocab = ["#" if x[0].isdigit() else x for x in w.vocab]
    return w, hashes(vocab)[w.codes] if len(w.codes) else np.zeros(0, np.uint64)


def _runs(h: np.ndarray, owner: np.ndarray, at: np.ndarray, masked_only: bool = False) -> list[np.ndarray]:
    """Buckets of the runs of words that end at the positions ``at``, by family."""
    back = []
    for k in range(4):
        x = np.zeros(len(at), np.uint64)
        ok = at >= k
        ok[ok] = owner[at[ok] - k] == owner[at[ok]]
        x[ok] = h[at[ok] - k]
        back.append(x)
    low = np.uint64((1 << BITS) - 1)
    with np.errstate(over="ignore"):
        if masked_only:
            key = mix(back[1], 2) + mix(back[2], 3) + mix(back[3], 4)
            return [(mix(key, 24) & low).astype(np.int64) + (4 << BITS)]
        m = [mix(x, k + 1) for k, x in enumerate(back)]
        keys = [m[0] + m[1] + m[2] + m[3], m[0] + m[1] + m[2], m[0] + m[1], m[0], m[1] + m[2] + m[3]]
    return [(mix(x, 20 + k) & low).astype(np.int64) + (k << BITS) for k, x in enumerate(keys)]


def _single(h: np.ndarray) -> np.ndarray:
    """Buckets of the words as runs of their own."""
    return (mix(mix(h, 1), 23) & np.uint64((1 << BITS) - 1)).astype(np.int64) + (3 << BITS)


def _extension_key(before: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64((1 << BITS) - 1)
    with np.errstate(over="ignore"):
        return (mix(mix(before, 2) + mix(part, 31), 25) & low).astype(np.int64) + (EXT2 << BITS), (mix(part, 32) & low).astype(np.int64) + (EXT1 << BITS)


def _closing(texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray], list[str], np.ndarray]:
    """For texts with words: their index, run buckets, closing word and its extension buckets."""
    w, h = _coded(tails(texts))
    has = np.flatnonzero(w.counts > 0)
    at = w.offsets[1:][has] - 1
    owner = w.owners()
    runs = _runs(h, owner, at)
    last = [w.vocab[c] for c in w.codes[at]]
    before = np.zeros(len(at), np.uint64)
    ok = at >= 1
    ok[ok] = owner[at[ok] - 1] == owner[at[ok]]
    before[ok] = h[at[ok] - 1]
    part = hashes(last) if len(last) else np.zeros(0, np.uint64)
    return has, runs, last, np.stack(_extension_key(before, part)) if len(has) else np.zeros((2, 0), np.int64)


def _sorted(got: pa.Table) -> np.ndarray:
    """Keys in order and their counts."""
    keys, n = got.column(0).to_numpy(), got.column(1).to_numpy()
    order = np.argsort(keys)
    return np.stack([keys[order], n[order]])


def closing_counts(texts: DataFrame, with_states: bool = False, times: str | None = None) -> list[np.ndarray | str] | tuple[list[np.ndarray | str], np.ndarray]:
    """How often the closing runs of the column ``text`` end a text and how often they go on.

    with_states: and the terminality of each of STATES, which is how often a
    text ends in it among all that stand in it; 1 where none does.

    times: a column that tells how many equal texts a row stands for.

    The first pass gathers the closing runs, the second counts them inside all
    texts, whole texts as they are. Each part of the result has sorted keys and
    both counts as its rows and holds the keys of one remainder by the number
    of parts. Beyond KEYS runs each part is counted in a pass of its own and
    becomes a file that the executors map, so that neither the driver nor a
    task holds more than one part.
    """
    spark = texts.sparkSession
    texts = texts.select("text", (F.lit(1) if times is None else F.col(times)).cast("long").alias("n"))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, int] = {}
        in_state = np.zeros(2 * len(STATES), np.int64)
        for b in batches:
            t, n = b.column(0), b.column(1).to_numpy()
            if with_states:
                in_state += np.concatenate([states(t) @ n, goings_on(t, n)])
            left = ~closed(t)
            t, n = t.filter(pa.array(left)), n[left]
            left = ~opened(t) & ~emptied(t)
            t, n = t.filter(pa.array(left)), n[left]
            has, runs, _, ext = _closing(t)
            keys, where = np.unique(np.concatenate([*runs, *ext]), return_inverse=True)
            sums = np.bincount(where, weights=np.tile(n[has], len(runs) + len(ext)), minlength=len(keys)).astype(np.int64)
            for k, c in zip(keys.tolist(), sums.tolist()):
                kept[k] = kept.get(k, 0) + c
        # States have keys below zero.
        kept |= {-1 - k: int(n) for k, n in enumerate(in_state) if n}
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.int64()), pa.array(list(kept.values()), pa.int64())], ["key", "n"])

    counted = stage(texts.mapInArrow(ends, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "closing")
    closing = counted.where("key >= 0")
    parts = max(1, -(-counted.count() // KEYS))
    # Where one part holds all, it is fetched once.
    table = _sorted(counted.toArrow()) if parts == 1 else None
    few = _sorted(counted.where("key < 0").toArrow()) if table is None else table[:, table[0] < 0]
    of = {int(-1 - k): int(n) for k, n in few.T}
    stand = [(of.get(k, 0), of.get(k + len(STATES), 0)) for k in range(len(STATES))]
    terminality = np.array([e / (e + i) if e + i else 1.0 for e, i in stand])
    fold = lambda keys: (keys >> BITS) << 20 | (keys & ((1 << 20) - 1))
    # Words that end some text, of all parts.
    words = np.zeros(FAMILIES << 20, bool)
    if table is None:
        ends_with = closing.where(F.shiftright("key", BITS) == 3).select(F.col("key").bitwiseAND((1 << 20) - 1).alias("low")).distinct().toArrow().column(0).to_numpy()
    else:
        ends_with = table[0][table[0] >> BITS == 3] & ((1 << 20) - 1)
    words[(3 << 20) + ends_with] = True
    sent_words = spark.sparkContext.broadcast(words)
    out: list[np.ndarray | str] = []
    for part in range(parts):
        keys, n_end = table[:, table[0] >= 0] if table is not None else _sorted(closing.where(F.pmod("key", F.lit(parts)) == part).toArrow())
        done = np.stack([keys, n_end, _inside(texts, keys, sent_words, fold)])
        if parts > 1:
            path = f"{tempfile.mkdtemp(prefix='verisieve-')}/closing-{uuid.uuid4().hex}.npy"
            np.save(path, done)
            spark.sparkContext.addFile(path)
            done = path.rsplit("/", 1)[1]
        out.append(done)
    return (out, terminality) if with_states else out


def _inside(texts: DataFrame, keys: np.ndarray, sent_words: Broadcast, fold: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """How often each of the sorted keys goes on inside the texts, of which each row has ``n`` equal ones."""
    sent = texts.sparkSession.sparkContext.broadcast(keys)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(FAMILIES << 20, bool)
        wanted[fold(sent.value)] = True
        sums = np.zeros(len(sent.value), np.int64)

        def add(buckets: np.ndarray, weight: np.ndarray) -> None:
            ok = np.flatnonzero(wanted[fold(buckets)])
            at = np.minimum(np.searchsorted(sent.value, buckets[ok]), len(sums) - 1)
            hit = sent.value[at] == buckets[ok]
            sums[:] += np.bincount(at[hit], weights=weight[ok[hit]], minlength=len(sums)).astype(np.int64)

        for b in batches:
            w, h = _coded(prose(b.column(0)))
            if not len(h):
                continue
            owner = w.owners()
            n = b.column(1).to_numpy()[owner]
            at = np.arange(len(h))
            last = np.zeros(len(h), bool)
            last[w.offsets[1:][w.counts > 0] - 1] = True
            # Runs that end with a word that ends no text are none of those wanted.
            ends_some = sent_words.value[fold(_single(h))] & ~last
            for k, x in enumerate(_runs(h, owner, at[ends_some])):
                if k < 4:
                    add(x, n[ends_some])
            add(_runs(h, owner, at[~last], masked_only=True)[0], n[~last])
            # Beginnings of longer words, after the word before; words at an end may be cut themselves.
            size = len(w.vocab)
            before = np.zeros(len(h), np.int64)  # the word before, 0 for none
            same = np.flatnonzero(owner[1:] == owner[:-1]) + 1
            before[same] = w.codes[same - 1] + 1
            of = np.concatenate([np.zeros(1, np.uint64), hashes(["#" if x[0].isdigit() else x for x in w.vocab])])
            begin = [[x[:k] for k in range(1, len(x))] if x[0].isalpha() and len(x) < 40 else [] for x in w.vocab]
            flat = hashes([p for ps in begin for p in ps]) if any(begin) else np.zeros(0, np.uint64)
            whose = np.repeat(np.arange(size), [len(ps) for ps in begin])
            # Of the beginnings, those that end some text as words.
            ends_one = sent_words.value[fold(_single(flat))]
            flat, whose = flat[ends_one], whose[ends_one]
            count = np.bincount(whose, minlength=size)
            start = np.cumsum(count) - count
            mine = np.flatnonzero(~last & (count[w.codes] > 0))
            pair, which = np.unique((before * size + w.codes)[mine], return_inverse=True)
            sums_of = np.bincount(which, weights=n[mine], minlength=len(pair))
            c = pair % size
            times = count[c]
            where = np.repeat(start[c] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            e2, e1 = _extension_key(np.repeat(of[pair // size], times), flat[where])
            add(e2, np.repeat(sums_of, times))
            add(e1, np.repeat(sums_of, times))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["at", "n"])

    n_in = np.zeros(len(keys), np.int64)
    if len(keys):
        got = texts.mapInArrow(inside, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        n_in[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return n_in


class Terminality:
    """Scores of endings by the counts of ``closing_counts``."""

    def __init__(self, counts: list[np.ndarray | str], support: int = 4):
        self.parts = [np.load(SparkFiles.get(x), mmap_mode="r") if isinstance(x, str) else x for x in counts]
        self.support = support

    def _look(self, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        end, inn = np.zeros(len(buckets), np.int64), np.zeros(len(buckets), np.int64)
        of = buckets % len(self.parts)
        for part, (keys, ends, ins) in enumerate(self.parts):
            mine = np.flatnonzero(of == part)
            if not len(keys) or not len(mine):
                continue
            at = np.minimum(np.searchsorted(keys, buckets[mine]), len(keys) - 1)
            hit = keys[at] == buckets[mine]
            end[mine], inn[mine] = np.where(hit, ends[at], 0), np.where(hit, ins[at], 0)
        return end, inn

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(terminality, fragment) of each text; 1 and False where there are no words.

        terminality: how often the longest known run of closing words, or that
        run with any last word, ends a text. fragment: the last word is the
        beginning of longer words that go on here and hardly stands there itself.
        """
        score, fragment = np.ones(len(texts)), np.zeros(len(texts), bool)
        rest = np.flatnonzero(~closed(texts))
        has, runs, last, ext = _closing(texts.take(pa.array(rest)))
        has = rest[has]
        if not len(has):
            return score, fragment
        got = [self._look(x) for x in runs]
        best = np.full(len(has), -1.0)
        for e, i in got[:4]:
            ok = (best < 0) & (e + i >= self.support)
            best[ok] = (e / np.maximum(1, e + i))[ok]
        e, i = got[4]
        ok = e + i >= self.support
        best[ok] = np.maximum(best, e / np.maximum(1, e + i))[ok]
        best[best < 0] = 0.5
        e2, x2 = self._look(ext[0])
        e1, x1 = self._look(ext[1])
        i2, i1 = got[2][1], got[3][1]
        alpha = np.array([x[0].isalpha() for x in last])
        fragment[has] = alpha & (((x2 >= 2) & (x2 > 2 * i2) & (x2 > e2)) | ((i1 == 0) & (x1 >= 1) & (x1 > e1)))
        best[np.array([x in ",;:([{<-–—/&+*=" for x in last])] = 0.0
        best[np.array([x == "§" for x in last])] = 1.0
        score[has] = best
        return score, fragment


_NUMBER = re.compile(r"\d+")


def shortened_number(text: str) -> bool:
    """The text ends in a number that begins the last longer number before it."""
    m = re.search(r"(\d+)\D?$", text[-40:])
    if m is None or m.end(1) != len(text[-40:]):
        return False
    last = m.group(1)
    before = _NUMBER.findall(text[: len(text) - len(last)])
    return bool(before) and len(before[-1]) > len(last) and before[-1].startswith(last)
