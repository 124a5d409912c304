"""Merkle manifest of a dataset: one digest for all rows, and for each row the proof that it is in it.

Rows are leaves, in order within groups; a tree over each group ends in a subroot, a tree over
the subroots in the root. A level is one aggregation by parent: conditional aggregates spread its
children into one column for each slot. All columns together are hashed to the parent; all but
the own slot are a child's siblings. Proofs go down the same rows: a parent's proof, found once, is
handed to its children, so that a level costs its own number of nodes and no row meets each level
by a join of its own. Everything is built of Spark's functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

FANOUT = 8
PATH = "array<struct<before:string,after:string>>"
#: Bits of monotonically_increasing_id below the partition's number.
ROW_BITS = 33


def sha(text: Column) -> Column:
    """Lowercase hex sha256 of a text's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """A value so written that no two lists of values look alike: byte count, colon, value; a
    null is a hyphen."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return sha(F.concat(*[field(v) for v in values]))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(path, leaf, lambda below, p: sha(F.concat(p["before"], below, p["after"])))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return sha(F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), ""))


def ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows (a written table with a column g) with pos, the place within g in the order of by, from
    0, and n, the rows of g. Rows are dealt by ranges of (g, by), so a large g is in many tasks;
    what is summed is one row for each g and task."""
    numbered = staged(rows.repartitionByRange("g", *by).sortWithinPartitions("g", *by).withColumn("at", F.monotonically_increasing_id()))
    task = F.shiftright("at", ROW_BITS)
    per = numbered.groupBy("g", task.alias("task")).agg(F.min("at").alias("least"), F.count("*").alias("many"))
    own = Window.partitionBy("g")
    before = F.coalesce(F.sum("many").over(own.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = staged(per.select(F.col("g").alias("g2"), F.col("task").alias("task2"), (before - F.col("least")).alias("shift"), F.sum("many").over(own).alias("n")))
    found = numbered.join(per, (F.col("g") == F.col("g2")) & (task == F.col("task2")))
    return found.withColumn("pos", F.col("at") + F.col("shift")).drop("at", "g2", "task2", "shift")


def _parents(nodes: DataFrame, child: Column, fanout: int) -> DataFrame:
    """The runs of nodes (g, pos, n, digest): g, pos and n of each parent, its children as columns s0,
    s1, .. (null from where there are fewer) and its digest."""
    slot = F.pmod("pos", F.lit(fanout))
    spread = [F.max(F.when(slot == i, child)).alias(f"s{i}") for i in range(fanout)]
    runs = nodes.groupBy("g", F.expr(f"pos div {fanout}").alias("pos")).agg(F.max("n").alias("n"), *spread)
    every = F.concat_ws("", *[F.col(f"s{i}")["digest"] for i in range(fanout)])
    return runs.withColumn("digest", sha(every)).withColumn("n", F.ceil(F.col("n") / fanout).cast("long"))


def _handed_down(runs: DataFrame, upper: DataFrame, fanout: int) -> DataFrame:
    """g, pos, child, path and top of the children of runs; upper has g, pos, path and top of the
    runs themselves."""

    def child(i: int) -> Column:
        others = lambda js: F.concat_ws("", *[F.col(f"s{j}")["digest"] for j in js]) if js else F.lit("")
        step = F.struct(others(range(i)).alias("before"), others(range(i + 1, fanout)).alias("after"))
        return F.struct((F.col("pos") * fanout + i).alias("pos"), F.col(f"s{i}").alias("child"), F.concat(F.array(step), F.col("path")).alias("path"))

    both = runs.join(upper, ["g", "pos"])
    out = both.select("g", "top", F.explode(F.array(*[child(i) for i in range(fanout)])).alias("c"))
    return out.where("c.child is not null").select("g", "c.pos", "c.child", "c.path", "top")


def _tree(nodes: DataFrame, child: Column, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels of all groups' trees from nodes (a written table; g, pos, n, digest) upwards, each a
    written table of runs, and (g, digest, height) of the tops."""
    levels, tops, height = [], nodes.where("n = 1").select("g", "digest", F.lit(0).alias("height")), 0
    many = nodes.agg(F.max("n")).first()[0] or 0
    while many > 1:
        nodes, height = staged(_parents(nodes.where("n > 1"), child, fanout)), height + 1
        child = F.struct("digest")
        levels.append(nodes)
        tops = tops.unionByName(nodes.where("n = 1").select("g", "digest", F.lit(height).alias("height")))
        many = -(-many // fanout)
    return levels, tops


def _proofs(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame, child: Column, fanout: int) -> DataFrame:
    """g, child, path and top of each of nodes; tops has g, height, path and top."""
    upper = None
    for height in range(len(levels), -1, -1):
        here = tops.where(F.col("height") == height).select("g", F.lit(0).cast("long").alias("pos"), "path", "top")
        if height == 0:
            alone = nodes.where("n = 1").select("g", child.alias("child")).join(here, "g").select("g", "child", "path", "top")
            return alone.unionByName(below.select("g", "child", "path", "top")) if levels else alone
        upper = here if upper is None else here.unionByName(below.select("g", "pos", "path", "top"))
        below = _handed_down(levels[height - 1], upper, fanout)
        if height > 1:
            below = staged(below)
    return None


def manifest(leaves: DataFrame, group: str, order: list[str], leaf: str = "leaf", fanout: int = FANOUT) -> DataFrame:
    """leaves with subroot, root and path, the siblings of the leaf and of its parents up to the root as
    an array of (before, after): texts of digests to be put before and after the own one.

    leaves has a row for each leaf; its other columns are kept. Leaves of a group (a null one is a
    group, the first) stand in the order of order, then of their digests, nulls first; so rows
    that repeat have leaves next to each other and any order of equal ones gives the same
    root. While a group has more than one node, each fanout consecutive ones, the last run maybe
    fewer, are hashed to one; a group of one leaf is its subroot. Subroots, in the order of the
    groups' UTF-8 bytes, give the root in the same way. No leaves: no rows."""
    names = leaves.columns
    key = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    rows = staged(leaves.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), key.alias("g"), F.col(leaf).alias("digest"), *[F.col(c).alias(f"by{i}") for i, c in enumerate(order)]))
    by = [f"by{i}" for i in range(len(order))]
    nodes = staged(ranked(rows, [*by, "digest"]).drop(*by))
    first, only = F.struct("digest", "row"), F.struct("digest")
    levels, tops = _tree(nodes, first, fanout)

    tops = staged(tops)
    above = staged(ranked(staged(tops.select(F.lit("").alias("g"), F.col("g").alias("of"), "digest", "height")), ["of"]))
    top_child = F.struct("digest", "of", "height")
    top_levels, root = _tree(above, top_child, fanout)
    found = root.first()
    start = root.select("g", "height", F.array().cast(PATH).alias("path"), F.col("digest").alias("top"))
    under = _proofs(above, top_levels, start, top_child, fanout)
    under = staged(under.select(F.col("child.of").alias("g"), F.col("child.height").alias("height"), "path", F.col("child.digest").alias("top")))
    proofs = _proofs(nodes, levels, under, first, fanout)
    return proofs.select("child.row.*", F.col("top").alias("subroot"), F.lit(found.digest if found else None).cast("string").alias("root"), "path")


def document_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row of docs (columns
    doc_id, source, lang, n_chars, text; others are ignored, rows that repeat are leaves of their own).

    The root is that of the rows as they are. folded_root is made from the siblings and a leaf
    that has been tampered with where 3 divides crc32 of the id's text: its text's A-Z lower-cased. So verified
    is false there if the text has any of them. Nulls are digested as nulls; a null id is
    never tampered with."""
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = leaf_digest(*[F.col(c) for c in names[:-1]], F.translate("text", letters, letters.lower()))
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaves = docs.select("doc_id", "lang", leaf_digest(*[F.col(c) for c in names]).alias("leaf"), F.when(chosen, tampered).alias("tampered"))
    made = manifest(leaves, "lang", ["doc_id"])
    out = made.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
