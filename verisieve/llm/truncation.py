"""Problem 2: outputs that stop in the middle."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stage
from .endings import Terminality, broken_off, closing_counts, emptied, shortened_number, states
from .words import Words, hashes, mix

#: Words of a shingle, and the similarity from which two texts are near-copies.
WIDTH, SIMILAR = 5, 0.8
#: Bands of min-hash values: 7 bands of 3 find a pair of similarity 0.8 with probability 0.993.
BANDS, ROWS = 7, 3
_BANDS = [f"band{k}" for k in range(BANDS)]
#: Lengths in words of the beginnings that have a band of their own, so that copies cut anywhere meet their wholes.
LEVELS = tuple(8 * 2**k for k in range(17))
#: Last characters of a copy that must stand in its whole.
TAIL = 16
#: Hashes of texts that are sent to all tasks at most.
SENT = 1_000_000
#: Bits that tell which words follow a beginning.
AHEAD = 60
#: White space.
SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
#: Closing runs that end a text less often than this leave it open.
OPEN = 0.15
#: From here on an end between two words is sound even where a longer copy goes on.
CLOSED = 0.3


def _plain_words(texts: pa.Array) -> Words:
    """White-space separated words as they stand."""
    parts = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.fill_null(texts.cast(pa.large_string()), "")))
    flat = pc.list_flatten(parts)
    coded = pc.dictionary_encode(flat)
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    return Words(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), coded.dictionary.to_pylist())


def _slots(level: int) -> tuple[int, int]:
    """Words after a beginning that are told, up to the next one, and the bits of each."""
    words = min(AHEAD, LEVELS[level + 1] - LEVELS[level] if level + 1 < len(LEVELS) else AHEAD)
    return words, AHEAD // words


def signed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each text's BANDS hashes of shingle minima, parity sketch and number of distinct shingles; then the hashes of its beginnings, what follows each, their offsets, and which bits of the last one's a copy must share.

    Texts of fewer than WIDTH words have one shingle. The sketch has a bit for
    the parity of the shingles that fall on it, so two sketches differ in no
    more bits than the sets differ in shingles. A beginning is hashed at each of
    LEVELS words that the text has before its last one, by the first band's minima over it; what
    follows are some bits of each word up to the next level. A copy shares
    those of all its words but the last, which may be cut.
    """
    w = _plain_words(texts)
    n = len(texts)
    h = hashes(w.vocab)[w.codes]
    starts, counts = w.offsets[:-1], w.counts
    total = len(h)
    run = np.zeros(total, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WIDTH):
            run = run * np.uint64(0x100000001B3) + np.append(h[k:], np.zeros(min(k, total), np.uint64))
    # Positions too close to the end repeat the text's last full shingle.
    owner = w.owners()
    last = starts + np.maximum(counts - WIDTH, 0)
    run = run[np.minimum(np.arange(total), last[owner])]
    # Each order of the shingles is a multiply-add of the halves of their hashes.
    mixed = mix(run, 1)
    low, high = mixed.astype(np.uint32), (mixed >> np.uint64(32)).astype(np.uint32)
    odd = mix(np.arange(2 * BANDS * ROWS, dtype=np.uint64), 5).astype(np.uint32) | np.uint32(1)
    x, y = np.empty(total, np.uint32), np.empty(total, np.uint32)
    out = np.empty((n, BANDS), np.uint64)
    reach = [np.flatnonzero(counts > size) for size in LEVELS if n and counts.max() > size]
    begin = [np.zeros(len(at), np.uint64) for at in reach]
    for b in range(BANDS):
        key = np.zeros(n, np.uint64)
        for r in range(ROWS):
            with np.errstate(over="ignore"):
                np.multiply(low, odd[2 * (b * ROWS + r)], out=x)
                np.multiply(high, odd[2 * (b * ROWS + r) + 1], out=y)
                x += y
                key = key * np.uint64(0x100000001B3) + mix(np.minimum.reduceat(x, starts).astype(np.uint64)) if n else key
                for k, at in enumerate(reach if b == 0 else []):
                    ends = np.stack([starts[at], starts[at] + LEVELS[k] - WIDTH + 1], 1).ravel()
                    begin[k] = begin[k] * np.uint64(0x100000001B3) + mix(np.minimum.reduceat(x, np.minimum(ends, total - 1))[::2].astype(np.uint64))
        out[:, b] = mix(key, b)
    # Distinct shingles of each text: its number above 40 bits of the hash.
    each = np.sort(owner.astype(np.uint64) << np.uint64(40) | mixed >> np.uint64(24))
    each = each[np.append(True, each[1:] != each[:-1])] if total else each
    owner = (each >> np.uint64(40)).astype(np.int64)
    parity = np.bincount(owner * 64 + (each & np.uint64(63)).astype(np.int64), minlength=n * 64) % 2
    sketch = np.packbits(parity.astype(bool).reshape(n, 64), axis=1).view(np.int64).ravel()
    whose = np.concatenate(reach) if reach else np.zeros(0, np.int64)
    keys = np.concatenate([mix(x, 200 + k) for k, x in enumerate(begin)]) if reach else np.zeros(0, np.uint64)
    follow, must = [], np.zeros(n, np.int64)
    for k, at in enumerate(reach):
        words, bits = _slots(k)
        ahead = np.zeros(len(at), np.int64)
        for i in range(words):
            have = np.flatnonzero(counts[at] > LEVELS[k] + i)
            ahead[have] |= (h[starts[at[have]] + LEVELS[k] + i] >> np.uint64(3)).astype(np.int64) % (1 << bits) << (i * bits)
        follow.append(ahead)
        shared = np.clip(counts[at] - 1 - LEVELS[k], 0, words) * bits
        must[at] = (np.int64(1) << shared) - 1
    follow = np.concatenate(follow) if reach else np.zeros(0, np.int64)
    order = np.argsort(whose, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=n))]).astype(np.int32)
    return out, sketch, np.bincount(owner, minlength=n), keys[order], follow[order], offsets, must


def band_keys(texts: pa.Array) -> np.ndarray:
    """BANDS hashes of each text's shingle minima."""
    return signed(texts)[0]


def _shingles(words: list[str]) -> set[tuple[str, ...]]:
    return set(zip(*(words[i:] for i in range(WIDTH)))) if len(words) >= WIDTH else {tuple(words)}


@functools.lru_cache(maxsize=16)
def _copied(copy: str) -> tuple[list[str], set[tuple[str, ...]]]:
    """Words of a copy, and the shingles of all but its last one."""
    words = copy.split()
    return words, _shingles(words[:-1])


def _stands_alike(copy: str, whole: str, words: list[str], mine: set[tuple[str, ...]]) -> bool:
    """The copy's last characters stand in ``whole``, whose words are given, after a part that may be similar enough."""
    tail, at, part, shared, done = copy[-TAIL:], -1, set(), 0, 0
    while (at := whole.find(tail, at + 1)) >= 0:
        before = len(whole[: at + len(tail)].split()) - 1
        if before < WIDTH:
            own = _shingles(words[:before])
            both, size = len(mine & own), len(own)
        else:
            # Each part holds the one before it.
            new = set(zip(*(words[done + i : before - WIDTH + 1 + i] for i in range(WIDTH)))) - part
            part |= new
            shared, done = shared + len(new & mine), before - WIDTH + 1
            both, size = shared, len(part)
        if both >= SIMILAR * (len(mine) + size - both) - 2:
            return True
    return False


def jaccard(a: str, b: str) -> float:
    """Similarity of two texts' sets of word shingles."""
    x, y = _shingles(a.split()), _shingles(b.split())
    return len(x & y) / max(1, len(x | y))


def _goes_on_inside_a_word(copy: str, whole: str) -> bool:
    """The copy's last characters stand in the whole with a letter or digit after them."""
    tail, at = copy.rstrip()[-TAIL:], -1
    while (at := whole.find(tail, at + 1)) >= 0:
        if whole[at + len(tail) : at + len(tail) + 1].isalnum():
            return True
    return False


def aligned(copy: str, whole: str) -> tuple[str, str] | None:
    """What ``copy``'s last word lacks of the word that it is aligned with, and the words of ``whole`` after that; None where they are no near-copies up to there.

    The beginning of ``whole`` that ends where the copy's alignment ends must
    have the similarity SIMILAR with the copy. A copy that is a beginning
    itself is aligned as it stands; others by matching blocks of words, of
    which the last must reach the copy's last or last but one word.
    """
    copy, whole = copy.rstrip(), whole.rstrip()
    if whole.startswith(copy):
        rest = whole[len(copy) :]
        lacks = "" if not rest or rest[0].isspace() else rest.split(None, 1)[0]
        return lacks, rest[len(lacks) :].strip()
    (a, mine), b = _copied(copy), whole.split()
    # Only where the copy's last characters stand after a part that is similar enough is it worth aligning.
    if not _stands_alike(copy, whole, b, mine):
        return None
    blocks = [x for x in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if x.size]
    if not blocks:
        return None
    end = blocks[-1]
    stop, at = end.a + end.size, end.b + end.size
    if stop < len(a) - 1:
        return None
    lacks = ""
    if stop == len(a) - 1:
        # The last word is cut: it begins the one that stands there in the whole.
        if at >= len(b) or not b[at].startswith(a[-1]):
            return None
        lacks, at = b[at][len(a[-1]) :], at + 1
    x, y = _shingles(a[:stop]), _shingles(b[: at - (1 if lacks else 0)])
    if len(x & y) < SIMILAR * len(x | y):
        return None
    return lacks, " ".join(b[at:])


def outputs(candidates: DataFrame, traces: DataFrame) -> DataFrame:
    """tab, row_ord, text of both tables."""
    c = candidates.select(F.lit("candidates").alias("tab"), "row_ord", "text")
    return c.unionByName(traces.select(F.lit("traces").alias("tab"), "row_ord", F.col("prediction").alias("text")))


def _distinct(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """cls, n, text of each distinct text and how many rows have it.

    rows: tab, row_ord, cls. Only hashes are grouped and travel; one row of each
    text brings it along.
    """
    row = lambda cls: F.xxhash64("tab", "row_ord", cls)
    kept = stage(rows.groupBy("cls").agg(F.min(row("cls")).alias("row"), F.count("*").cast("int").alias("n")).select("row", "n"), "kept")
    size = kept.count()
    each = texts.select(row(F.xxhash64("text")).alias("row"), "text").join(F.broadcast(kept) if size <= SENT else kept, "row").select(F.xxhash64("text").alias("cls"), "n", "text")
    each = stage(each, "texts")
    # A row that is there more than once brings its text more than once.
    return each if each.count() == size else stage(each.groupBy("cls").agg(F.first("n").alias("n"), F.min("text").alias("text")), "texts")


def _hashed(each: DataFrame, counts: list, ending: np.ndarray) -> DataFrame:
    """cls, mark, sketch, how, band0 and further bands, begins, follow, must of all distinct texts that aren't empty.

    ``mark`` holds a text's length, its number of shingles, whether its end
    closes it and whether it may be a copy, since what is shuffled here is most of all.
    """
    sent = each.sparkSession.sparkContext.broadcast((counts, ending))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, ending = sent.value
        scorer = Terminality(counts)
        for b in batches:
            b = b.filter(pa.array(~emptied(b.column(1))))
            if not b.num_rows:
                continue
            t = b.column(1)
            score, fragment = scorer.score(t)
            # The state that the end stands in has a terminality of its own.
            in_state = states(t)
            score = np.minimum(score, np.where(in_state, ending[:, None], 1.0).min(0))
            how = np.where(fragment, 2, np.where(score < OPEN, 3, np.where(broken_off(t), 1, 0)))
            strip = pc.utf8_rtrim_whitespace(t)
            digit = pc.match_substring_regex(strip, r"\d$").to_numpy(zero_copy_only=False).astype(bool) & (how == 0)
            for k in np.flatnonzero(digit):
                if shortened_number(strip[int(k)].as_py()):
                    how[k] = 2
            keys, sketch, n, begins, follow, offsets, must = signed(t)
            closes = score >= CLOSED
            # Only a cut inside a word or an unlikely end can be a copy's; the others are wholes only.
            asks = ~closes | pc.match_substring_regex(strip, r"[\pL\pN]$").to_numpy(zero_copy_only=False).astype(bool)
            mark = pc.utf8_length(t).to_numpy(zero_copy_only=False).astype(np.int64) << 32 | n << 2 | closes * 2 | asks
            lists = (pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (begins.view(np.int64), follow))
            bands = (pa.array(np.ascontiguousarray(keys[:, k]).view(np.int64)) for k in range(BANDS))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(mark), pa.array(sketch), pa.array(how.astype(np.int8)), *bands, *lists, pa.array(must)], ["cls", "mark", "sketch", "how", *_BANDS, "begins", "follow", "must"])

    schema = f"cls long, mark long, sketch long, how byte, {', '.join(f'{x} long' for x in _BANDS)}, begins array<long>, follow array<long>, must long"
    return each.select("cls", "text").mapInArrow(scan, schema)


def _meetings(each: DataFrame, done: DataFrame | None) -> DataFrame:
    """cls, whole, closes: texts whose end may be a cut with longer texts that share a band.

    The band of a beginning meets where the copy has no longer one and goes on
    with the same words up to its end; first (``done`` is None) one such text,
    the longest, is kept for each copy, afterwards all of them, but for the
    copies that are done. Bands of whole texts come with these; they meet where
    a sketch of the shingles doesn't rule out the similarity.
    """
    asks = F.col("mark") % 2 == 1
    longer = F.shiftright("most", 32) > F.shiftright("mark", 32)
    closes = (F.col("mark").bitwiseAND(2) == 2).alias("closes")
    same = F.col("mine").bitwiseXOR(F.col("follow")).bitwiseAND(F.col("must")) == 0
    top = each.where(asks & (F.size("begins") > 0)).select("cls", "mark", "must", F.element_at("begins", -1).alias("key"), F.element_at("follow", -1).alias("mine"))
    begins = each.select(F.col("cls").alias("whole"), F.col("mark").alias("most"), F.explode(F.arrays_zip("begins", "follow")).alias("b")).select("whole", "most", F.col("b.begins").alias("key"), "b.follow")
    begun = lambda top, begins: top.join(begins, "key").where(longer & same).select("cls", "whole", closes, "most")
    if done is None:
        return begun(top, begins).groupBy("cls", "closes").agg(F.max_by("whole", "most").alias("whole")).select("cls", "whole", "closes")
    bands = each.select("cls", "mark", "sketch", F.explode(F.array(*_BANDS)).alias("key"))
    wholes = bands.select("key", F.col("cls").alias("whole"), F.col("mark").alias("most"), F.col("sketch").alias("other"))
    shingles = lambda c: F.shiftright(F.col(c).bitwiseAND((1 << 32) - 1), 2)
    # Sets of a and b shingles that differ in d of them are SIMILAR up to 9 d = a + b; two more pass for a cut last word.
    differ = F.greatest(F.bit_count(F.col("sketch").bitwiseXOR(F.col("other"))), F.abs(shingles("mark") - shingles("most")))
    alike = differ * 9 <= shingles("mark") + shingles("most") + 18
    ask, top = bands.where(asks).join(done, "cls", "left_anti"), top.join(done, "cls", "left_anti")
    whole = ask.join(wholes, "key").where(longer & alike).select("cls", "whole", closes)
    return whole.unionByName(begun(top, begins).drop("most")).distinct()


def _sized(hashes: DataFrame, label: str) -> DataFrame:
    """A set of hashes that goes to all tasks if it is of checked size; a larger one makes the rows come to it."""
    hashes = stage(hashes, label)
    return F.broadcast(hashes) if hashes.count() <= SENT else hashes


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """cls: copies of the pairs whose alignment ends early in a verified whole."""
    need = _sized(pairs.select("cls").union(pairs.select("whole")).distinct(), "need")
    text = stage(texts.select("cls", "text").join(need, "cls", "left_semi"), "near-texts")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: set[int] = set()  # one whole is enough
            for cls, x, y, closes in zip(*(b.column(j).to_pylist() for j in range(4))):
                if cls in found or (closes and not _goes_on_inside_a_word(x, y)):
                    continue
                got = aligned(x, y)
                if got is None:
                    continue
                lacks, after = got
                mid = lacks[:1].isalnum() and x.rstrip()[-1].isalnum()
                # Between words, a longer copy may just have gone on after a sound end.
                if mid or (not closes and (lacks or after)):
                    found.add(cls)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64())], ["cls"])

    # The copy's last characters stand in the whole, or nothing there is aligned with its end; only they travel to the wholes.
    # As many last bytes are told without counting the text's characters, and no more than those characters.
    tail = F.substring(F.rtrim("text", F.lit(SPACE)).cast("binary"), -TAIL, TAIL).cast("string")
    tail = text.select("cls", tail.alias("tail"))
    whole = text.select(F.col("cls").alias("whole"), F.col("text").alias("whole_text"))
    both = pairs.join(tail, "cls").join(whole, "whole").where(F.contains("whole_text", "tail")).join(text, "cls")
    return stage(both.select("cls", "text", "whole_text", "closes").mapInArrow(verify, "cls long").distinct(), "verified")


def cut_copies(each: DataFrame, texts: DataFrame) -> DataFrame:
    """cls: hashes of texts that are near-copies of a longer text and end early in it.

    each: what ``_hashed`` tells of the distinct ``texts``. One whole is enough.
    The longest text that goes on as a copy does is tried first; only copies
    that it doesn't settle meet all others, so that a band that many copies
    share costs one alignment a copy.
    """
    first = _verified(stage(_meetings(each, None), "near"), texts)
    rest = stage(_meetings(each, first), "near")
    return first.unionByName(_verified(rest, texts))


def cut_outputs(texts: DataFrame) -> DataFrame:
    """tab, row_ord, how: the outputs that stop in the middle of a word, sentence or structure.

    how is ``copy`` where a longer near-copy goes on in the middle of the last
    word or after an unlikely end, ``word`` where the last word is the
    beginning of another, ``sentence`` where the closing words, or the bracket,
    fence or list mark that is open there, hardly ever end a text, ``mark``
    where a character is broken or a mark says that more followed.

    Near-copies come from min-hash bands over five-word shingles of whole texts
    and of their beginnings, and are verified on the part that they are aligned
    with. Equal texts are read once and count as often as they are there. Null, blank and empty outputs are no cases;
    repeated rows are cases of their own.
    """
    texts = texts.where(F.col("text").isNotNull())
    rows = stage(texts.select("tab", "row_ord", F.xxhash64("text").alias("cls")), "outputs")
    texts = _distinct(rows, texts)
    counts, ending = closing_counts(texts, with_states=True, times="n")
    each = stage(_hashed(texts, counts, ending), "classes")
    early = cut_copies(each, texts).withColumn("copy", F.lit(True))
    name = F.when(F.col("copy"), "copy").when(F.col("how") == 1, "mark").when(F.col("how") == 2, "word").when(F.col("how") == 3, "sentence")
    cut = each.select("cls", "how").join(early, "cls", "left").select("cls", name.alias("how")).where("how is not null")
    return rows.join(_sized(cut, "cut"), "cls").select("tab", "row_ord", "how")


def cut_rates(cut: DataFrame, candidates: DataFrame, traces: DataFrame) -> DataFrame:
    """tab, source, n, n_cut, share: per model_id and backend of candidates, and per run_id of traces; a null part reads ``?``."""
    c = candidates.select(F.lit("candidates").alias("tab"), "row_ord", F.concat_ws("/", F.coalesce("model_id", F.lit("?")), F.coalesce("backend", F.lit("?"))).alias("source"))
    rows = c.unionByName(traces.select(F.lit("traces").alias("tab"), "row_ord", F.coalesce("run_id", F.lit("?")).alias("source")))
    rows = rows.join(cut.select("tab", "row_ord", F.lit(1).alias("cut")), ["tab", "row_ord"], "left")
    g = rows.groupBy("tab", "source").agg(F.count("*").alias("n"), F.count("cut").alias("n_cut"))
    return g.withColumn("share", F.col("n_cut") / F.col("n"))
