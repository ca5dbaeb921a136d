"""Problem 6: mixing sources to target shares."""

from __future__ import annotations

import base64
import importlib.util
from collections.abc import Iterator
from itertools import groupby
from pathlib import Path

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stage

#: Undecided documents that one task settles at most.
LANDING = 5_000
TOLERANCE = 1e-9
#: Rows that a task hands on at once.
OUT = 20_000


def default_vocabulary() -> str:
    """The vocabulary file of the installed public tokenizers."""
    spec = importlib.util.find_spec("public_tokenizers")
    root = Path(spec.origin).parent if spec and spec.origin else Path("/opt/tokenizers")
    return str(root / "byte_bpe_50k.tiktoken")


def token_counts(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, source, n_tokens by a public byte-level tokenizer; a null text has none."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [len(coder.encode_ordinary(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "n_tokens"])

    return documents.select("doc_id", "source", "text").mapInArrow(run, "doc_id long, source string, n_tokens long")


def plan_rates(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """source, target_share, max_repeats, tokens, goal, rate: how often each source's documents are used on average.

    Without ``total_tokens`` the mixture is as large as it can be with every
    source that has tokens at its target. With it, a source that can't supply
    its part within its cap supplies all that it can. Targets that are null or
    not positive count as 0, caps that are null as 1.
    """
    t = targets.where("source is not null").groupBy("source").agg(F.max(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("max_repeats"))
    s = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    t = t.join(s, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    cap = F.col("max_repeats") * F.col("tokens")
    if total_tokens is None:
        whole = t.where("target_share > 0 and tokens > 0").agg(F.coalesce(F.min(cap / F.col("target_share")), F.lit(0.0)).alias("whole"))
    else:
        whole = t.sparkSession.range(1).select(F.lit(float(total_tokens)).alias("whole"))
    goal = F.least(F.col("target_share") * F.col("whole"), cap.cast("double"))
    t = t.crossJoin(F.broadcast(whole)).withColumn("goal", goal)
    return t.withColumn("rate", F.when(F.col("tokens") > 0, F.col("goal") / F.col("tokens")).otherwise(0.0)).drop("whole")


def _draw(seed: int, doc: int, turn: int) -> float:
    """A number in [0, 1) that only depends on its arguments, so that a task that runs again decides alike."""
    return xxhash.xxh3_64_intdigest(f"{seed}|{doc}|{turn}") / 2.0**64


def flight(units: Iterator[tuple[int, int, float]], seed: int) -> Iterator[tuple[int, int, float]]:
    """Moves the probabilities of (key, size, probability) along the null space of their number and size until at most two units are open.

    Yields every unit with 0 or 1, and the open ones last with what is left.
    """
    held: list[list] = []
    turn = 0
    for key, size, p in units:
        if p <= TOLERANCE or p >= 1 - TOLERANCE:
            yield key, size, round(p)
            continue
        held.append([key, size, p])
        while len(held) == 3:
            (_, a, _), (_, b, _), (_, c, _) = held
            u = (b - c, c - a, a - b) if not a == b == c else (1, -1, 0)
            up = min((1 - x[2]) / d if d > 0 else x[2] / -d for x, d in zip(held, u) if d)
            down = min(x[2] / d if d > 0 else (1 - x[2]) / -d for x, d in zip(held, u) if d)
            turn += 1
            move = up if _draw(seed, held[0][0], turn) * (up + down) < down else -down
            for x, d in zip(held, u):
                x[2] += move * d
            still = []
            for x in held:
                if x[2] <= TOLERANCE or x[2] >= 1 - TOLERANCE:
                    yield x[0], x[1], round(x[2])
                else:
                    still.append(x)
            held = still
    for x in held:
        yield tuple(x)


def land(units: list[tuple[int, int, float]], seed: int) -> list[tuple[int, int, float]]:
    """Settles the units that a flight left open: the size is given up first, then the number."""
    if len(units) == 2:
        (k, s, p), (l, t, q) = units
        if _draw(seed, k, 1) < 0.5:
            (k, s, p), (l, t, q) = (l, t, q), (k, s, p)
        total = p + q
        if total <= 1:
            first = _draw(seed, k, 2) * total < p
            p, q = (total, 0.0) if first else (0.0, total)
        else:
            first = _draw(seed, k, 2) * (2 - total) < 1 - q
            p, q = (1.0, total - 1) if first else (total - 1, 1.0)
        units = [(k, s, p), (l, t, q)]
    return [(k, s, float(_draw(seed, k, 3) < p)) for k, s, p in units]


def balanced_mixture(sizes: DataFrame, rates: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, source, n_tokens, copies: each document with how often it is used, where that is at least once.

    copies is the whole part of its source's rate, plus one for a balanced
    sample of the source's documents: the cube method keeps both the number
    and the tokens of the sample at what the rate asks for. Every task flies
    over its own documents and hands on at most two open ones a source; these
    are flown over again in ever fewer tasks until one lands the rest.
    """
    s = sizes.join(F.broadcast(rates.select("source", "rate")), "source").where("rate > 0 and doc_id is not null")
    s = s.select("doc_id", "source", "n_tokens", F.floor("rate").cast("int").alias("base"), (F.col("rate") - F.floor("rate")).alias("p"))

    def run(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
        # Rows come by source; a flight takes them one by one and holds no more than three.
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        done: list[tuple] = []

        def flown() -> Iterator[tuple]:
            for (source, base), units in groupby(rows, key=lambda r: (r[1], r[3])):
                open_ = []
                for doc, n, p in flight(((r[0], r[2], r[4]) for r in units), seed):
                    if last and p not in (0, 1):
                        open_.append((doc, n, p))
                    else:
                        yield doc, source, n, base, float(p)
                for doc, n, p in land(open_, seed):
                    yield doc, source, n, base, float(p)

        for row in flown():
            done.append(row)
            if len(done) == OUT:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names)
                done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names)

    schema = "doc_id long, source string, n_tokens long, base int, p double"
    names, kinds = ["doc_id", "source", "n_tokens", "base", "p"], [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.float64()]
    decided, open_ = [], s.sortWithinPartitions("source", "base", "doc_id")
    while True:
        flown = stage(open_.mapInArrow(lambda it: run(it, False), schema), "flown")
        decided.append(flown.where("p = 0 or p = 1"))
        open_ = flown.where("p > 0 and p < 1")
        n = open_.count()
        if n <= LANDING:
            break
        open_ = open_.repartition(max(1, n // LANDING)).sortWithinPartitions("source", "doc_id")
    decided.append(stage(open_.coalesce(1).sortWithinPartitions("source", "doc_id").mapInArrow(lambda it: run(it, True), schema), "landed"))
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "source", "n_tokens", (F.col("base") + F.col("p")).cast("int").alias("copies")).where("copies > 0")


def reached_shares(mixture: DataFrame, rates: DataFrame) -> DataFrame:
    """source, target_share, tokens, share, n_docs, n_copies, most_copies, reached: what each source supplies of the whole.

    reached: its share is within a hundredth of the target's size or within
    0.001 of it. A source without tokens supplies 0.
    """
    m = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used"), F.count("*").alias("n_docs"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_copies"))
    total = m.agg(F.coalesce(F.sum("used"), F.lit(0)).alias("whole"))
    r = rates.select("source", "target_share", "max_repeats").join(m, "source", "left").crossJoin(F.broadcast(total))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    share = F.when(F.col("whole") > 0, F.coalesce("used", F.lit(0)) / F.col("whole")).otherwise(0.0)
    near = F.abs(share - F.col("target_share")) <= F.greatest(0.01 * F.col("target_share"), F.lit(0.001))
    return r.select("source", "target_share", "max_repeats", F.coalesce("used", F.lit(0)).alias("tokens"), share.alias("share"), zero("n_docs"), zero("n_copies"), zero("most_copies"), near.alias("reached"))
