"""Problem 5: passages of evaluation items inside training documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import split

#: Largest number of item words that one pass holds; more items take more passes.
ITEM_WORDS_A_PASS = 2_000_000
#: Words of a verbatim match that the binary search starts from.
SEED = 3
#: Share of its words that a stretch has to match.
DENSE = 0.7
#: Meetings of item and corpus positions that are held at once; texts are taken in runs of about so many.
MEETINGS = 4_000_000


class Items:
    """Word codes of evaluation items, laid end to end with a gap code 0."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        w = split(pa.array(texts, pa.string()))
        self.ids = np.array(ids, np.int64)
        self.code_of = {word: k + 1 for k, word in enumerate(w.vocab)}
        self.digit = np.array([False] + [any(c.isdigit() for c in word) for word in w.vocab])
        self.words = [w.codes[a:b] + 1 for a, b in zip(w.offsets[:-1], w.offsets[1:])]
        self.seq = np.concatenate([np.concatenate([x, [0]]) for x in self.words] or [np.zeros(1, np.int64)])
        self.item = np.concatenate([np.full(len(x) + 1, k) for k, x in enumerate(self.words)] or [np.zeros(1, np.int64)])
        self.start = np.concatenate([[0], np.cumsum([len(x) + 1 for x in self.words])])[: len(self.words)]
        # Words that few items have are an item's own: names, places, numbers, resources.
        have = np.zeros(len(self.code_of) + 1, np.int64)
        for x in self.words:
            have[np.unique(x)] += 1
        self.own = (have <= max(2, 0.25 * len(self.words))) & (have > 0)
        # Every suffix is looked up, stock wording that many items share too.
        keys = gram_keys(self.seq)
        self.suffixes = np.flatnonzero(keys >= 0)
        self.keys = keys[self.suffixes]


def gram_keys(seq: np.ndarray) -> np.ndarray:
    """SEED successive codes packed in one integer, -1 where a gap falls in."""
    n = len(seq)
    out, gap = np.zeros(n, np.int64), np.zeros(n, bool)
    for k in range(SEED):
        part = np.zeros(n, np.int64)
        part[: n - k] = seq[k:]
        out, gap = out << 21 | part, gap | (part == 0)
    out[gap] = -1
    return out


def suffix_array(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the corpus suffixes in the order of their words, and the sorted seed keys.

    Ordered to two seeds' depth; longer matches are told apart by extension.
    """
    keys = gram_keys(seq)
    at = np.flatnonzero(keys >= 0)
    deeper = np.full(len(at), -1, np.int64)
    inside = at + SEED < len(seq)
    deeper[inside] = keys[at[inside] + SEED]
    order = np.lexsort((deeper, keys[at]))
    return at[order], keys[at[order]]


def longest_matches(items: Items, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item position, corpus position and length of each verbatim match that can't be extended to the left; all of them, in no order."""
    where, keys = suffix_array(seq)
    lo, hi = np.searchsorted(keys, items.keys, "left"), np.searchsorted(keys, items.keys, "right")
    many = hi - lo
    # Most meetings go on to the left, so only so many are held before those are left out.
    ends = np.cumsum(many)
    cuts = np.searchsorted(ends, np.arange(MEETINGS, ends[-1] if len(ends) else 0, MEETINGS), "left") + 1
    out = []
    for part in np.split(np.arange(len(many)), np.unique(cuts)):
        n = many[part]
        i = np.repeat(items.suffixes[part], n)
        j = where[np.repeat(lo[part] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n, n) + np.arange(len(i))] if len(i) else np.zeros(0, np.int64)
        before = (i > 0) & (j > 0)
        same = np.zeros(len(i), bool)
        same[before] = (items.seq[i[before] - 1] == seq[j[before] - 1]) & (items.seq[i[before] - 1] > 0)
        out.append((i[~same], j[~same]))
    i, j = (np.concatenate(x) for x in zip(*out))
    length = np.full(len(i), SEED, np.int64)
    live = np.arange(len(i))
    while len(live):
        a, b = i[live] + length[live], j[live] + length[live]
        ok = (a < len(items.seq)) & (b < len(seq))
        ok[ok] = (items.seq[a[ok]] == seq[b[ok]]) & (items.seq[a[ok]] > 0)
        live = live[ok]
        length[live] += 1
    return i, j, length


def can_hold(present: np.ndarray, own: np.ndarray, share: float, own_share: float) -> np.ndarray:
    """Texts by item words: which texts have words enough for a stretch of ``share`` of the item.

    ``best_stretch`` finds none in the others that counts: any stretch that long
    has too few of its words, or of its own words, anywhere in the text.
    """
    n = present.shape[1]
    least = max(1, int(np.ceil(share * n)))
    out = np.ones(len(present), bool)
    for gain in (present - DENSE, own * (present - own_share)):
        sums = np.concatenate([np.zeros((len(present), 1)), np.cumsum(gain, axis=1)], axis=1)
        # The best sum of a stretch that ends at each word and is long enough.
        out &= (sums[:, least:] - np.minimum.accumulate(sums, axis=1)[:, : n + 1 - least] >= -1e-6).any(1)
    return out


def best_stretch(item: np.ndarray, text: np.ndarray, own: np.ndarray) -> tuple[int, int, int]:
    """Words of the longest stretch of ``item`` that ``text`` holds in order; own words matched and missed in it.

    The stretch may skip single words on either side (light edits, markup,
    short insertions); it ends where more than a few item words in a row are
    missing.
    """
    from difflib import SequenceMatcher

    blocks = [b for b in SequenceMatcher(None, item.tolist(), text.tolist(), autojunk=False).get_matching_blocks() if b.size]
    best = (0, 0, 0)
    runs: list[list] = []
    for b in blocks:
        if b.size < 2 and not own[item[b.a]]:
            continue
        if runs and b.a - (runs[-1][-1].a + runs[-1][-1].size) <= 6 and b.b - (runs[-1][-1].b + runs[-1][-1].size) <= 30:
            runs[-1].append(b)
        else:
            runs.append([b])
    for run in runs:
        a, z = run[0].a, run[-1].a + run[-1].size
        if z - a > best[0] and sum(b.size for b in run) >= DENSE * (z - a):
            matched = sum(int(own[item[b.a : b.a + b.size]].sum()) for b in run)
            best = (z - a, matched, int(own[item[a:z]].sum()) - matched)
    return best


def leaks_of(items: Items, texts: pa.Array, share: float, own_share: float = 0.85) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, words held, own words matched, own words missed) of a shard of texts, of all pairs that can reach both shares."""
    w = split(texts)
    to = np.fromiter((items.code_of.get(x, 0) for x in w.vocab), np.int64, len(w.vocab))
    known = to[w.codes] if len(w.codes) else np.zeros(0, np.int64)
    n, owner = len(texts), w.owners()
    # One gap code after each text keeps matches inside a text.
    seq = np.zeros(len(known) + n, np.int64)
    seq[np.arange(len(known)) + owner] = known
    # Texts are taken together as long as their words meet few item words.
    keys, ordered = gram_keys(seq), np.sort(items.keys)
    meet = np.searchsorted(ordered, keys, "right") - np.searchsorted(ordered, keys, "left")
    starts = w.offsets[:-1] + np.arange(n)
    total = np.concatenate([[0], np.cumsum(meet * (keys >= 0))])[np.append(starts, len(seq))]
    a = 0
    while a < n:
        z = max(a + 1, int(np.searchsorted(total, total[a] + MEETINGS, "right")) - 1)
        end = starts[z] if z < n else len(seq)
        for t, *found in _leaks_of_run(items, seq[starts[a] : end], starts[a:z] - starts[a], share, own_share):
            yield a + t, *found
        a = z


def _leaks_of_run(items: Items, seq: np.ndarray, starts: np.ndarray, share: float, own_share: float) -> Iterator[tuple[int, int, int, int, int]]:
    """``leaks_of`` for texts that are laid end to end, each with a gap code after it."""
    i, j, length = longest_matches(items, seq)
    if not len(i):
        return
    bounds = np.append(starts, len(seq))
    text_of = np.searchsorted(starts, j, "right") - 1
    order = np.lexsort((j, text_of * len(items.ids) + items.item[i]))
    j, pair = j[order], (text_of * len(items.ids) + items.item[i])[order]
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    pairs, last = pair[first], np.append(first[1:], len(pair))
    total = np.add.reduceat(length[order], first)
    size = np.array([len(x) for x in items.words])
    cand = np.flatnonzero(total >= 0.5 * share * size[pairs % len(items.ids)])
    # Distinct known words of each text, as numbers in order.
    width = len(items.own)
    have = np.unique(np.repeat(np.arange(len(starts)), np.diff(bounds)) * width + seq)
    cand = cand[np.argsort(pairs[cand] % len(items.ids), kind="stable")]
    for of in np.split(cand, np.flatnonzero(np.diff(pairs[cand] % len(items.ids))) + 1) if len(cand) else []:
        item = int(pairs[of[0]] % len(items.ids))
        words, span = items.words[item], len(items.words[item])
        step = max(1, MEETINGS // span)
        for part in (of[k : k + step] for k in range(0, len(of), step)):
            wanted = (pairs[part] // len(items.ids))[:, None] * width + words[None, :]
            present = have[np.minimum(np.searchsorted(have, wanted), len(have) - 1)] == wanted
            for k in part[can_hold(present, items.own[words], share, own_share)]:
                t = int(pairs[k] // len(items.ids))
                at = j[first[k] : last[k]] - starts[t]
                codes = seq[starts[t] : bounds[t + 1] - 1]
                found = (0, 0, 0)
                # Windows around the matches; each is about the size of the item.
                for g in np.split(at, np.flatnonzero(np.diff(at) > span) + 1):
                    a, b = max(0, g[0] - span), min(len(codes), g[-1] + 2 * span)
                    found = max(found, best_stretch(words, codes[a:b], items.own))
                yield t, item, *found


def evaluation_leaks(documents: DataFrame, items: DataFrame, share: float = 0.4, own_share: float = 0.85) -> DataFrame:
    """Documents that hold passages of evaluation items.

    Every task sorts the suffixes of its shard of documents into an array and
    finds all item suffixes in it by binary search; matches are extended to
    their longest verbatim length, and documents whose matches cover enough of
    an item are aligned with it word by word. The corpus is not shuffled, the
    items are sent to the tasks in passes of at most ITEM_WORDS_A_PASS words.

    Returns doc_id, item_id, n_words (item words held), own_hit, own_miss.
    A null or blank text or item holds nothing; repeated rows are cases of
    their own; further columns are ignored.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text").where(F.col("text").isNotNull())
    out, block, words = None, [], 0
    rows = items.select("item_id", "item_text").where(F.col("item_text").isNotNull() & F.col("item_id").isNotNull()).orderBy("item_id").toLocalIterator(prefetchPartitions=True)

    def scan(block: list) -> DataFrame:
        sent = spark.sparkContext.broadcast(([r[0] for r in block], [r[1] for r in block]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Items(*sent.value)
            for batch in batches:
                ids = batch.column(0)
                got = [(ids[t].as_py(), int(own.ids[i]), n, hit, miss) for t, i, n, hit, miss in leaks_of(own, batch.column(1), share, own_share) if n >= share * len(own.words[i]) and hit >= own_share * (hit + miss)]
                cols = list(zip(*got)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.int32()) for c in cols[2:])], ["doc_id", "item_id", "n_words", "own_hit", "own_miss"])

        return docs.mapInArrow(run, "doc_id long, item_id long, n_words int, own_hit int, own_miss int")

    for r in rows:
        size = len(r[1].split()) + 1
        if block and words + size > ITEM_WORDS_A_PASS:
            part, block, words = scan(block), [], 0
            out = part if out is None else out.unionByName(part)
        block.append((r[0], r[1]))
        words += size
    part = scan(block)
    return part if out is None else out.unionByName(part)


def clean_documents(documents: DataFrame, leaks: DataFrame) -> DataFrame:
    """The documents without those that leak; a null doc_id is kept."""
    return documents.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti")


def leaked_items(leaks: DataFrame) -> DataFrame:
    """item_id, n_docs: how many documents leak each item."""
    return leaks.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"))
