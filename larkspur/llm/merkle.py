"""A Merkle manifest of a dataset, and a proof for every record by coordinate lookup.

1. Leaves. A record's leaf is the digest of its columns, each ``-`` if null, else its length in bytes, ``:``, its value.
   Leaves are numbered by id within their group (``numbered``: ranges and their offsets, so a group of any size is
   spread), and groups by name, null first.
2. Node table. Every ``fanout`` consecutive nodes of a level are a run, whose concatenated digests make a node of the
   level above, until one is left: the group's subroot. Subroots are the leaves of one more tree, the root's. The table
   has a row a run, keyed by coordinates (tree, level, run) and written level by level; tree is a group's number, or -1
   for the root's. Runs hold ``fanout`` nodes at most, so no row and no group of the aggregation grows with the data.
3. Proofs. From its index and its group's size each leaf explodes the coordinates of the runs that hold its siblings,
   step by step up to the root; they are joined with the node table, ordered, and concatenated without the leaf's own
   places, which gives the proof, and folded from any digest of the leaf, which gives the root that it vouches for.

Digests are SHA-256: 32 bytes in the tables, lower-case hex where they are inputs of another digest. Levels of few runs,
by their counts, are broadcast; the others are joined by shuffle, which adaptive execution splits where a run is asked
for by very many leaves.

Defined cases: a null id is a leaf like any other, before all others of its group; rows with the same id are ordered by
their leaves; equal rows are leaves each, in any order, as their digests are equal; null and empty texts differ, as
``-`` and ``0:``; texts of any length are digested whole; a group of one has its leaf as subroot and a single group's
subroot is the root, with proofs of no siblings (the digest of nothing); an empty table gives an empty result; columns
that are not named are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from larkspur.llm.common import if_small, remove, written
from larkspur.operators.numbering import numbered

FANOUT = 16
#: The tree over the subroots.
TOP = -1
#: Runs up to which levels are broadcast, of 32 bytes a node; groups up to which they are.
FEW_RUNS, FEW_GROUPS = 20_000, 100_000
COORDINATES = ["tree", "level", "run"]


def field(c: Column) -> Column:
    """A value with its length in bytes before it; integers in decimal."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def record_digest(*columns: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256))


def hexed(c: Column) -> Column:
    return F.lower(F.hex(c))


def _of_hex(texts: Column) -> Column:
    """The digest, as hex, of digests in hex one after the other."""
    return F.sha2(F.array_join(texts, "").cast("binary"), 256)


def _div(i: Column, fanout: int, exponent: Column) -> Column:
    # powers of doubles are exact up to 2 ** 53, beyond any index
    return F.call_function("div", i, F.pow(F.lit(float(fanout)), exponent).cast("long"))


def _depth(n: int, fanout: int) -> int:
    """Levels of runs over n nodes."""
    depth = 0
    while fanout**depth < n:
        depth += 1
    return depth


@dataclass
class Manifest:
    """Written tables: leaves (g, tree, i and the columns they came with), groups (tree, name, size, depth, subroot), and the
    node table, a frame a level (tree, level, run, digests, digest), of the groups' trees and of the root's."""

    leaves: DataFrame
    groups: DataFrame
    levels: list[DataFrame]
    top_levels: list[DataFrame]
    fanout: int

    @property
    def root(self) -> DataFrame:
        """(root): one row, none for an empty table."""
        last = self.top_levels[-1].select(hexed(F.col("digest")).alias("root")) if self.top_levels else self.groups.select(F.col("subroot").alias("root"))
        return last.limit(1)


def _grown(nodes: DataFrame, depth: int, fanout: int) -> list[DataFrame]:
    """The runs of all levels over nodes (tree, i, depth, digest), each level written before the next is made of it."""
    levels = []
    for level in range(depth):
        placed = F.struct((F.col("i") % fanout).alias("place"), "digest")
        runs = nodes.where(F.col("depth") > level).groupBy("tree", "depth", _div(F.col("i"), fanout, F.lit(1)).alias("run")).agg(F.sort_array(F.collect_list(placed)).alias("placed"))
        digests = F.col("placed.digest")
        runs = runs.select("tree", F.lit(level).alias("level"), "run", "depth", digests.alias("digests"), F.unhex(_of_hex(F.transform(digests, hexed))).alias("digest"))
        levels.append(written(runs, "merkle-runs"))
        nodes = levels[-1].select("tree", F.col("run").alias("i"), "depth", "digest")
    return levels


def build(records: DataFrame, group: str, order: list[str], fanout: int = FANOUT) -> Manifest:
    """The manifest of records with a binary ``digest`` and a group, ordered by ``order`` in it; they should be narrow, as
    all their columns are carried along. A column ``name`` is not taken, as the groups' values are called so."""
    leaves = written(records, "merkle-digests")
    # equal rows are spread by a number drawn for each, as rows that are equal in the order share a range
    keys = [F.asc_nulls_first(c) for c in (group, *order, "digest")]
    stored = written(numbered(leaves, *keys, F.rand(29), name="i", start=0, by=group).withColumn("g", F.monotonically_increasing_id()), "merkle-numbered")
    sizes = written(stored.groupBy(F.col(group).alias("name")).agg(F.count("*").alias("size")), "merkle-sizes")
    totals = sizes.agg(F.count("*").alias("groups"), F.max("size").alias("most")).first()
    depth, top = _depth(totals.most or 0, fanout), _depth(totals.groups, fanout)
    # how many powers of the fanout the size is above
    own = sum((F.when(F.col("size") > fanout**d, 1).otherwise(0) for d in range(depth)), F.lit(0)).cast("int")
    names = written(numbered(sizes, F.asc_nulls_first("name"), name="tree", start=0).withColumn("depth", own), "merkle-names")
    placed = stored.join(if_small(names.select("name", "tree", "depth"), FEW_GROUPS), F.col(group).eqNullSafe(F.col("name"))).drop("name")
    placed = written(placed, "merkle-leaves")
    levels = _grown(placed.select("tree", "i", "depth", "digest"), depth, fanout)
    ends = placed.where("depth = 0").select("tree", "digest")
    for level, runs in enumerate(levels):
        ends = ends.unionByName(runs.where(F.col("depth") == level + 1).select("tree", "digest"))
    groups = written(names.join(ends, "tree").withColumn("subroot", hexed(F.col("digest"))), "merkle-groups")
    tops = _grown(groups.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("i"), F.lit(top).alias("depth"), "digest"), top, fanout)
    for done in (leaves, stored, sizes, names):
        remove(done, records.sparkSession)
    return Manifest(placed, groups, levels, tops, fanout)


def _lookups(m: Manifest, carried: list[str]) -> DataFrame:
    """A row a leaf and step: the coordinates of the run that holds its siblings there, and its own place in that run."""

    def steps(depth: int, keep, tree: Column, index: Column, first: Column) -> Column:
        of = F.sequence(F.lit(0), F.lit(max(depth, 1) - 1))
        at = F.filter(of, keep)
        return F.transform(at, lambda l: F.struct((first + l).alias("step"), tree.alias("tree"), l.alias("level"), _div(index, m.fanout, l + 1).alias("run"), (_div(index, m.fanout, l) % m.fanout).cast("int").alias("place")))

    own = steps(len(m.levels), lambda l: l < F.col("depth"), F.col("tree"), F.col("i"), F.lit(0))
    top = steps(len(m.top_levels), lambda l: l < len(m.top_levels), F.lit(TOP).cast("long"), F.col("tree"), F.col("depth"))
    # a lone leaf of a lone group asks for nothing and stays
    asked = m.leaves.select("g", F.col("tree").alias("of"), *carried, F.explode_outer(F.concat(own, top)).alias("at"))
    return asked.select("g", "of", *carried, "at.*")


def _looked_up(m: Manifest, asked: DataFrame) -> DataFrame:
    """The coordinates with the digests of their runs."""
    few, joined, held = asked.where("level IS NULL").withColumn("digests", F.lit(None).cast("array<binary>")), [], 0
    small, small_at = [], []
    for of_top, levels in ((True, m.top_levels), (False, m.levels)):
        # the upper levels have the fewest runs
        for level in reversed(range(len(levels))):
            runs = levels[level].select(*COORDINATES, "digests")
            at = (F.col("level") == level) & ((F.col("tree") == TOP) if of_top else (F.col("tree") != TOP))
            n = runs.limit(FEW_RUNS + 1).count()
            if held + n <= FEW_RUNS:
                held += n
                small.append(runs)
                small_at.append(at)
            else:
                joined.append(asked.where(at).join(runs, COORDINATES))
    if small:
        runs, at = small[0], small_at[0]
        for more, more_at in zip(small[1:], small_at[1:]):
            runs, at = runs.unionByName(more), at | more_at
        joined.append(asked.where(at).join(F.broadcast(runs), COORDINATES))
    for more in joined:
        few = few.unionByName(more)
    return few


def proofs(m: Manifest, claimed: str, carried: list[str]) -> DataFrame:
    """(carried, leaf, subroot, root, proof_sha256, folded_root, verified) of each leaf: its proof, and the root that the
    digest in the column ``claimed`` folds to along it."""
    keys = ["g", "of", *carried, "digest", "claimed"]
    asked = _lookups(m, [*carried, "digest", claimed]).withColumnRenamed(claimed, "claimed")
    steps = _looked_up(m, asked).groupBy(*keys).agg(F.collect_list(F.when(F.col("level").isNotNull(), F.struct("step", "place", "digests"))).alias("steps"))
    path = F.sort_array("steps")
    siblings = F.flatten(F.transform(path, lambda s: F.transform(F.filter(s["digests"], lambda d, j: j != s["place"]), hexed)))
    folded = F.aggregate(path, hexed(F.col("claimed")), lambda node, s: _of_hex(F.transform(s["digests"], lambda d, j: F.when(j == s["place"], node).otherwise(hexed(d)))))
    out = steps.select("of", *carried, hexed(F.col("digest")).alias("leaf"), _of_hex(siblings).alias("proof_sha256"), folded.alias("folded_root"))
    groups = m.groups.select(F.col("tree").alias("of"), "subroot")
    # the root is one row
    found = out.join(if_small(groups, FEW_GROUPS), "of").crossJoin(F.broadcast(m.root))
    return found.select(*carried, "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
