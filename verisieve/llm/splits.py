"""Problem 4: splits that keep tied records together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import running
from ..sources.tables import drop_stage, stage

#: Authors that stand for "not known", after normalising.
NO_AUTHOR = ["", "-", "--", "?", "n/a", "na", "none", "null", "nil", "nan", "unknown", "not known", "anonymous", "anon", "unbekannt", "anonym", "inconnu", "anonyme", "desconocido", "tbd"]


#: Parts that a component's families are spread over where their pairs are formed.
SHARES = 16


def label_key(label: Column) -> Column:
    """One spelling of a family label: letters and digits only, numbers without leading zeros; null where nothing is left."""
    plain = F.regexp_replace(F.lower(label), r"[^\p{L}\p{N}]+", "")
    plain = F.regexp_replace(plain, r"(?<!\p{N})0+(?=\p{N})", "")
    return F.when(plain != "", plain)


def family_key_of(records: DataFrame) -> Column:
    """The family of a record: scenario_family_id or else task_family; ``playworld`` is none."""
    general = label_key(F.col("task_family"))
    return F.coalesce(label_key(F.col("scenario_family_id")), F.when(general != "playworld", general))


def ties(records: DataFrame, families: DataFrame) -> DataFrame:
    """Edges (a, b) between vertices ``fam:``, ``rec:``, ``author:`` and ``item:``.

    A record is tied to its family, its author, its source item and its
    parent, if that exists; a family to the one that it was forked from, if
    any record or registration has it. Nulls, blanks and stand-ins tie nothing.
    """
    r = records.select(
        F.concat(F.lit("rec:"), "id").alias("rec"),
        F.concat(F.lit("fam:"), family_key_of(records)).alias("fam"),
        F.lower(F.regexp_replace(F.regexp_replace(F.col("metadata")["author"], r"^[\s\x{A0}]+|[\s\x{A0}]+$", ""), r"^@\s*", "")).alias("author"),
        F.concat(F.lit("item:"), F.col("provenance.source_id"), F.lit("|"), F.col("metadata")["source_index"]).alias("item"),
        F.concat(F.lit("rec:"), F.col("metadata")["parent_id"]).alias("parent"),
    )
    # A record stands for itself by its family where it has one, else by its id.
    self = F.coalesce("fam", "rec")
    author = F.when(~F.col("author").isin(NO_AUTHOR), F.concat(F.lit("author:"), "author"))
    hub = r.select(self.alias("a"), F.explode(F.array("rec", author, "item")).alias("b")).where("b is not null and a <> b")
    child = r.where("parent is not null").select(self.alias("a"), F.col("parent").alias("b"))
    child = child.join(r.select(F.col("rec").alias("b")).where("b is not null").distinct(), "b", "left_semi").select("a", "b")
    known = F.concat(F.lit("fam:"), label_key(F.col("family_label")))
    fork = families.select(known.alias("a"), F.concat(F.lit("fam:"), label_key(F.col("forked_from"))).alias("b")).where("a is not null and b is not null and a <> b")
    return hub.unionByName(child).unionByName(fork).where("a is not null").distinct()


def _numbers(nodes: DataFrame, tries: int = 8) -> Callable[[str], Column]:
    """A 64-bit number of each node by hash; where two nodes would share one, with another salt."""
    for salt in range(tries):
        number = lambda c, salt=salt: F.xxhash64(F.col(c), F.lit(salt))
        if nodes.groupBy(number("node").alias("v")).count().where("count > 1").isEmpty():
            return number
    raise RuntimeError(f"two nodes share a number under each of {tries} salts")


def components(edges: DataFrame, rounds: int = 200, seed: int = 7) -> DataFrame:
    """node, root: connected components by random-mate contraction.

    Vertices that occur in a single edge are folded into their neighbour
    first, and undone last. In each round every vertex throws a coin; a tail
    with a head among its neighbours is merged into the smallest such head,
    edges are renamed and doubles dropped. Merges are kept as (child, parent)
    per round and unwound from the last round to the first.

    Null ends are ignored; a loop makes its vertex a component of its own.
    """
    spark = edges.sparkSession
    name = edges.where("a is not null and b is not null").select("a", "b").distinct()
    nodes = stage(name.select(F.col("a").alias("node")).unionByName(name.select(F.col("b").alias("node"))).distinct(), "nodes")
    number = _numbers(nodes)
    live = stage(name.select(number("a").alias("a"), number("b").alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    merges: list[DataFrame] = []
    for k in range(rounds):
        if live.isEmpty():
            break
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        head = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(seed * 1000 + k)), F.lit(2)) == 0
        degree = F.count("*")
        mate = both.groupBy("a").agg(F.min(F.when(head("b"), F.col("b"))).alias("mate"), degree.alias("n"), F.min("b").alias("only"))
        if k == 0:
            # Leaves need no coin: they join their only neighbour unless that is a leaf too and smaller ids wait for them.
            leaf = mate.where("n = 1").select("a", F.col("only").alias("parent"))
            pair = leaf.select(F.col("a").alias("parent"), F.col("parent").alias("back"))
            merged = leaf.join(pair, "parent", "left").where("back is null or a > parent").select(F.col("a").alias("child"), "parent")
        else:
            merged = mate.where("mate is not null").where(~head("a")).select(F.col("a").alias("child"), F.col("mate").alias("parent"))
        merged = stage(merged, "merge")
        merges.append(merged)
        to = lambda c: merged.select(F.col("child").alias(c), F.col("parent").alias(f"{c}_to"))
        after = live.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b"))
        after = stage(after.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        drop_stage(spark, live)
        live = after
    else:
        if not live.isEmpty():
            raise RuntimeError(f"edges are left after {rounds} rounds")
    # Unwind: the parent of a merge may itself be a child of a later round.
    roots = None
    for merged in reversed(merges):
        if roots is None:
            roots = merged.select(F.col("child").alias("v"), F.col("parent").alias("root"))
        else:
            step = merged.join(roots.select(F.col("v").alias("parent"), "root"), "parent", "left").select(F.col("child").alias("v"), F.coalesce("root", "parent").alias("root"))
            roots = roots.unionByName(step)
            if len(merges) > 4:
                roots = stage(roots, "roots")
    out = nodes.select("node", number("node").alias("v"))
    if roots is None:
        return out.select("node", F.col("v").alias("root"))
    return out.join(roots, "v", "left").select("node", F.coalesce("root", "v").alias("root"))


def family_components(records: DataFrame, families: DataFrame) -> DataFrame:
    """family_key, root: registered families with the component that they are in; a family without ties is its own."""
    comp = components(ties(records, families))
    f = families.where("family_key is not null").select("family_key", F.coalesce(F.concat(F.lit("fam:"), label_key(F.col("family_label"))), F.concat(F.lit("key:"), F.col("family_key").cast("string"))).alias("node"))
    return f.join(comp, "node", "left").select("family_key", F.coalesce("root", F.xxhash64("node")).alias("root"))


def bound_families(records: DataFrame, families: DataFrame) -> DataFrame:
    """family_a < family_b: pairs of families that must share a split, directly or through any chain."""
    c = stage(family_components(records, families), "families")
    many = c.groupBy("root").count().where("count > 1").select("root")
    c = c.join(many, "root", "left_semi")
    # Either side of a large component is spread over SHARES tasks, so that its pairs come from all of them.
    share = F.pmod(F.xxhash64("family_key"), F.lit(SHARES)).alias("share")
    a = c.select("root", share, F.col("family_key").alias("family_a")).distinct()
    b = c.select("root", F.explode(F.expr(f"sequence(0L, {SHARES - 1}L)")).alias("share"), F.col("family_key").alias("family_b")).distinct()
    return a.join(b, ["root", "share"]).where("family_a < family_b").select("family_a", "family_b")


def assign_splits(records: DataFrame, families: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """row_ord, id, root, split_name: every record with its new split.

    Components heavier than half the smallest target go to the split with the
    largest target first; the rest is laid out in hash order, and the middle
    of each component's stretch decides its split, so that the shares are met
    to within one component's weight. Targets are normalised; a null or
    non-positive target takes nothing. A record without family, author, item
    or parent is a component of its own, as is one without id.
    """
    goal = [(r[0], float(r[1])) for r in targets.where("split_name is not null and target_share > 0").groupBy("split_name").agg(F.sum("target_share")).orderBy(F.desc("sum(target_share)"), "split_name").collect()]
    if not goal:
        raise ValueError("no split has a positive target")
    whole = sum(s for _, s in goal)
    goal = [(n, s / whole) for n, s in goal]
    comp = components(ties(records, families))
    own = F.coalesce(F.concat(F.lit("fam:"), family_key_of(records)), F.concat(F.lit("rec:"), "id"), F.concat(F.lit("row:"), F.col("row_ord").cast("string")))
    r = records.select("row_ord", "id", own.alias("node")).join(comp, "node", "left").select("row_ord", "id", F.coalesce("root", F.xxhash64("node")).alias("root"))
    r = stage(r, "roots")
    sizes = stage(r.groupBy("root").agg(F.count("*").alias("weight")), "sizes")
    total = sizes.agg(F.sum("weight")).first()[0] or 0
    heavy = F.col("weight") > 0.5 * goal[-1][1] * total
    big = sizes.where(heavy).agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    # What the heavy components leave of each split, in the order of the targets.
    room, left = [], float(big)
    for _, s in goal:
        taken = min(left, s * total)
        left -= taken
        room.append(s * total - taken)
    edge, cuts = 0.0, []
    for (n, _), size in zip(goal, room):
        edge += size
        cuts.append((n, edge))
    light = running(sizes.where(~heavy).withColumn("_h", F.xxhash64("root", F.lit(seed))), ["_h", "root"], "weight")
    middle = F.col("before") + F.col("weight") / 2
    pick = F.lit(cuts[-1][0])
    for n, e in reversed(cuts[:-1]):
        pick = F.when(middle < e, F.lit(n)).otherwise(pick)
    chosen = light.select("root", pick.alias("split_name"))
    # Heavy components fill the splits in the same order, by size.
    order = running(sizes.where(heavy), [F.desc("weight"), F.asc("root")], "weight")
    heavy_pick = F.lit(goal[-1][0])
    for n, _ in reversed(goal[:-1]):
        edge = sum(x for _, x in goal[: [m for m, _ in goal].index(n) + 1]) * total
        heavy_pick = F.when(middle < edge, F.lit(n)).otherwise(heavy_pick)
    chosen = chosen.unionByName(order.select("root", heavy_pick.alias("split_name")))
    return r.join(chosen, "root").select("row_ord", "id", "root", "split_name")


def split_shares(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """split_name, target_share, n, share: what each split was to have and has; no assigned record gives shares of 0."""
    n = assigned.groupBy("split_name").agg(F.count("*").alias("n"))
    total = assigned.agg(F.count("*").alias("total"))
    return targets.join(n, "split_name", "left").crossJoin(F.broadcast(total)).select("split_name", "target_share", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("total") > 0, F.coalesce("n", F.lit(0)) / F.col("total")).otherwise(0.0).alias("share"))
