"""Commit graph: reachability, commits ahead, merge bases, references.

Edges are (child, parent). The history is covered by chains: each commit goes
on with one of its parents, and each parent with one of the children that
chose it, so a chain is a stretch of history without forks. ``chain_index``
gives each commit its chain and its place in it, by pointer doubling: after k
rounds a commit knows its ancestor 4^k further, so rounds grow with the
logarithm of the longest chain. The index depends on the edges alone and can be
kept as a table.

What a tip reaches is one place for each chain: all of the chain from there on.
A round takes the edges that leave the newly covered stretch of each chain, all
at once, and keeps the furthest place in which each other chain is entered. So
rounds grow with how often a path must change chains (branches nested in
branches), not with the number of commits or merges along them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riftscan.errors import ScanError
from riftscan.functions.lineage import cut

#: Pointers that a round of the index follows, and rounds of a walk that are planned together before what they find is written.
JUMPS, TOGETHER = 3, 2


def chain_index(edges: DataFrame) -> DataFrame:
    """node, chain (its last ancestor in the chain), pos (its distance from that) of every commit of the edges."""
    nodes = edges.select(F.col("child").alias("node")).union(edges.select("parent")).where("node is not null").distinct()
    chosen = edges.where("child is not null and parent is not null").groupBy("child").agg(F.max("parent").alias("at"))
    links = chosen.groupBy("at").agg(F.max("child").alias("node"))
    # A row is done when the commit that it points at is the chain's last one.
    start = F.col("at").isNull()
    state = cut(nodes.join(links, "node", "left").select("node", F.coalesce("at", "node").alias("at"), F.when(start, 0).otherwise(1).cast("bigint").alias("pos"), start.alias("done")))
    reach, most = 1, state.count()
    while not state.where("not done").isEmpty():
        further = state.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("pos").alias("more"), F.col("done").alias("ends"))
        moved = state.where("not done").drop("done")
        for _ in range(JUMPS):  # the chain's last commit points at itself
            moved = moved.join(further, "at").select("node", F.col("next").alias("at"), (F.col("pos") + F.col("more")).alias("pos"), F.col("ends").alias("done"))
        state = cut(state.where("done").unionByName(moved))
        reach *= JUMPS + 1
        if reach > (JUMPS + 1) * most:  # further than any chain is long
            raise ScanError("UNKNOWN", "the commit graph has a cycle")
    return state.select("node", F.col("at").alias("chain"), "pos")


def reachable(edges: DataFrame, tips: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """tip, node of every commit reachable from each tip, itself included."""
    index = chain_index(edges) if index is None else index
    end = lambda name: index.select(F.col("node").alias(name), F.col("chain").alias(f"{name}_chain"), F.col("pos").alias(f"{name}_pos"))
    leaving = cut(edges.join(end("child"), "child").join(end("parent"), "parent").where("child_chain <> parent_chain").select("child_chain", "child_pos", "parent_chain", "parent_pos"))
    tips = tips.select("tip").distinct()
    held = tips.join(index.withColumnRenamed("node", "tip"), "tip")
    # pos: how far a chain is reached; old: how far its edges were taken.
    state = held.select("tip", "chain", F.lit(-1).cast("bigint").alias("old"), "pos")
    while True:
        for _ in range(TOGETHER):
            fresh = state.where("pos > old")
            found = fresh.join(leaving, (fresh["chain"] == leaving["child_chain"]) & (F.col("child_pos") > F.col("old")) & (F.col("child_pos") <= F.col("pos")))
            entered = found.select("tip", F.col("parent_chain").alias("chain"), F.lit(-1).cast("bigint").alias("old"), F.col("parent_pos").alias("pos"))
            state = state.select("tip", "chain", F.col("pos").alias("old"), "pos").unionByName(entered).groupBy("tip", "chain").agg(F.max("old").alias("old"), F.max("pos").alias("pos"))
        state = cut(state)
        if state.where("pos > old").isEmpty():
            break
    up_to = state.select("tip", "chain", F.col("pos").alias("reach"))
    nodes = index.join(up_to, "chain").where("pos <= reach").select("tip", "node")
    alone = tips.join(index.select(F.col("node").alias("tip")), "tip", "left_anti").select("tip", F.col("tip").alias("node"))
    return nodes.unionByName(alone)


def tips_of(edges: DataFrame, *tips: object) -> DataFrame:
    kind = edges.schema["child"].dataType.simpleString()
    return edges.sparkSession.createDataFrame([(t,) for t in tips], f"tip {kind}")


def unique_commits(edges: DataFrame, base: object, tip: object, merges: bool = True) -> DataFrame:
    """node of the commits reachable from ``tip`` and not from ``base``; without merge commits if ``merges`` is false."""
    found = reachable(edges, tips_of(edges, base, tip))
    only = found.where(F.col("tip") == tip).select("node").join(found.where(F.col("tip") == base).select("node"), "node", "left_anti")
    if merges:
        return only
    merge = edges.groupBy("child").agg(F.count("*").alias("n")).where("n > 1").select(F.col("child").alias("node"))
    return only.join(merge, "node", "left_anti")


def commits_ahead(edges: DataFrame, a: object, b: object) -> DataFrame:
    """ahead_a, ahead_b, diverged: commits of each tip that the other can't reach."""
    found = reachable(edges, tips_of(edges, a, b))
    sides = found.groupBy("node").agg(F.bool_or(F.col("tip") == a).alias("in_a"), F.bool_or(F.col("tip") == b).alias("in_b"))
    return sides.agg(F.count_if(F.expr("in_a and not in_b")).alias("ahead_a"), F.count_if(F.expr("in_b and not in_a")).alias("ahead_b")).withColumn("diverged", F.expr("ahead_a > 0 and ahead_b > 0"))


def merge_bases(edges: DataFrame, a: object, b: object) -> DataFrame:
    """node of the best common ancestors: those that no other common ancestor reaches."""
    found = reachable(edges, tips_of(edges, a, b))
    common = cut(found.groupBy("node").agg(F.count_distinct("tip").alias("n")).where(F.col("n") == (1 if a == b else 2)).select("node"))
    inner = edges.join(common.select(F.col("node").alias("child")), "child").select(F.col("parent").alias("node"))
    return common.join(inner, "node", "left_anti")


def resolve_refs(refs: DataFrame, names: DataFrame) -> DataFrame:
    """asked, ref, sha: the first of refs/heads/x, refs/remotes/x and x that exists (null if none does)."""
    forms = F.array(*[F.struct(F.lit(k).alias("priority"), F.concat(F.lit(p), "asked").alias("ref")) for k, p in enumerate(("refs/heads/", "refs/remotes/", ""))])
    tried = names.select("asked", F.explode(forms).alias("x")).select("asked", "x.priority", "x.ref")
    hits = tried.join(refs.select(F.col("name").alias("ref"), "sha"), "ref")
    best = hits.groupBy("asked").agg(F.min_by(F.struct("ref", "sha"), "priority").alias("best"))
    return names.select("asked").distinct().join(best, "asked", "left").select("asked", "best.ref", "best.sha")


def branches_exist(refs: DataFrame, names: DataFrame) -> DataFrame:
    """asked, found: whether there is a branch or reference of each name."""
    return resolve_refs(refs, names).select("asked", F.col("ref").isNotNull().alias("found"))


def identical_branches(refs: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, identical: whether the names of each pair point at one commit; false if either is unknown."""
    known = resolve_refs(refs, pairs.select(F.col("a").alias("asked")).union(pairs.select("b")))
    of = lambda name: known.select(F.col("asked").alias(name), F.col("sha").alias(f"{name}_sha"))
    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce(F.col("a_sha") == F.col("b_sha"), F.lit(False)).alias("identical"))


def resolve_ref(refs: DataFrame, name: str) -> tuple[str, str]:
    """(ref, sha) of one name; an error if there is no such branch or reference."""
    names = refs.sparkSession.createDataFrame([(name,)], "asked string")
    row = resolve_refs(refs, names).first()
    if row["ref"] is None:
        raise ScanError("BRANCH_NOT_FOUND", f"no branch or reference named {name!r}")
    return row["ref"], row["sha"]


def branch_exists(refs: DataFrame, name: str) -> bool:
    try:
        resolve_ref(refs, name)
    except ScanError:
        return False
    return True


def branches_are_identical(refs: DataFrame, a: str, b: str) -> bool:
    """Whether two names point at one commit; false if either is unknown."""
    try:
        return resolve_ref(refs, a)[1] == resolve_ref(refs, b)[1]
    except ScanError:
        return False
