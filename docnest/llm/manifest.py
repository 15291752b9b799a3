"""A Merkle manifest of a dataset: one hash tree per group of rows, one over the groups, and a proof for every row.

Every level is a self-join: the slot-zero node of each run of FANOUT siblings computes the indices of the others (its own plus
the slot offsets), finds them by an equijoin on (tree, index), and emits the parent. The runs of each level are written; a pass
downwards then hands every run the path from its parent to the root, so a leaf's proof needs no join of its own.

Defined results: a null is hashed as "-", an empty text as "0:"; rows with one id follow one another by their leaf hash, null ids
come first; repeated rows are leaves of their own; a group of one leaf has it as subroot; an empty table has no rows, and its
root is None. A text's length matters to its own row only. Paths grow with the logarithm of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docnest.functions.ranking import RANK, ranked
from docnest.llm.frames import stored

FANOUT = 16
_PATH = "array<struct<before:string,after:string>>"


def encoded(value: Column) -> Column:
    """A value with its length in bytes in front, so that no two rows run together; "-" for a null."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def _runs(nodes: DataFrame, name: str) -> DataFrame:
    """(tree, run, members, alone) out of (tree, idx, node): each slot-zero node with its siblings in order, itself first.

    ``node`` is a struct whose first field is the digest. ``alone``: the run is the whole tree, of one node.
    """
    zero = nodes.where(F.col("idx") % FANOUT == 0)
    wanted = zero.select(
        F.col("tree").alias("its_tree"), F.expr(f"idx div {FANOUT}").alias("run"), F.posexplode(F.sequence("idx", F.col("idx") + (FANOUT - 1))).alias("slot", "sibling")
    )
    met = wanted.join(nodes, F.col("tree").eqNullSafe(F.col("its_tree")) & (F.col("idx") == F.col("sibling")))
    members = F.transform(F.sort_array(F.collect_list(F.struct("slot", "node"))), lambda m: m["node"])
    runs = met.groupBy("tree", "run").agg(members.alias("members"))
    return stored(runs.withColumn("alone", (F.col("run") == 0) & (F.size("members") == 1)), name)


def _digests(members: Column) -> Column:
    return F.transform(members, lambda m: m["digest"])


def _climb(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The runs of every level, leaves first, until each tree has come down to one node."""
    levels = [_runs(nodes, name)]
    while not levels[-1].where(~F.col("alone")).isEmpty():
        parents = levels[-1].where(~F.col("alone")).select(
            "tree", F.col("run").alias("idx"), F.struct(F.sha2(F.array_join(_digests(F.col("members")), ""), 256).alias("digest")).alias("node")
        )
        levels.append(_runs(parents, name))
    return levels


def _tops(levels: Sequence[DataFrame]) -> list[DataFrame]:
    """Per level the trees that end there: (tree, digest)."""
    return [level.where("alone").select("tree", F.col("members")[0]["digest"].alias("digest")) for level in levels]


def _entry(digests: Column, slot: Column) -> Column:
    """What a member's run puts before and after it."""
    before = F.array_join(F.slice(digests, F.lit(1), slot), "")
    after = F.array_join(F.slice(digests, slot + 2, F.lit(FANOUT)), "")
    return F.struct(before.alias("before"), after.alias("after"))


def _with_paths(levels: Sequence[DataFrame], above: DataFrame, name: str) -> DataFrame:
    """The lowest level's runs with the columns of ``above`` (tree, path, ...) of their parent: ``path`` leads from it to the root.

    ``above`` says for each tree what leads on from its top.
    """
    others = [c for c in above.columns if c not in ("tree", "path")]
    parents: DataFrame | None = None
    for depth in range(len(levels) - 1, -1, -1):
        ends = _tops(levels)[depth].select("tree")
        tops = above.withColumnRenamed("tree", "its_tree").join(ends, F.col("tree").eqNullSafe(F.col("its_tree")))
        tops = tops.select("tree", F.lit(0).cast("long").alias("idx"), "path", *others)
        parents = tops if parents is None else parents.unionByName(tops)
        parents = parents.select(F.col("tree").alias("its_tree"), "idx", "path", *others)
        runs = levels[depth].join(parents, F.col("tree").eqNullSafe(F.col("its_tree")) & (F.col("run") == F.col("idx"))).drop("its_tree", "idx")
        if depth == 0:
            return runs
        found = runs.select("tree", "run", "path", "alone", _digests(F.col("members")).alias("digests"), *others)
        members = found.select("tree", "run", "path", "alone", "digests", *others, F.posexplode("digests").alias("slot", "digest"))
        step = F.when(F.col("alone"), F.col("path")).otherwise(F.concat(F.array(_entry(F.col("digests"), F.col("slot"))), F.col("path")))
        parents = stored(members.select("tree", (F.col("run") * FANOUT + F.col("slot")).alias("idx"), step.alias("path"), *others), name)
    raise ValueError("a tree has at least one level")


def _fold(path: Column, start: Column) -> Column:
    """The root that ``start`` leads to along a path."""
    return F.aggregate(path, start, lambda digest, step: F.sha2(F.concat(step["before"], digest, step["after"]), 256))


class Manifest:
    """The trees of ``leaves``: (tree, id, leaf, other), the hash of each row and another one to be folded with its siblings.

    ``other`` null: the leaf itself. ``root`` is the hash over all trees, or None.
    """

    def __init__(self, leaves: DataFrame):
        rows = ranked(leaves.select("tree", "id", "leaf", "other"), ["tree"], ["id", "leaf"])
        node = F.struct(F.col("leaf").alias("digest"), F.col("id"), F.col("other")).alias("node")
        self.levels = _climb(rows.select("tree", F.col(RANK).cast("long").alias("idx"), node), "merkle")
        tops = _tops(self.levels)
        subroots = tops[0]
        for top in tops[1:]:
            subroots = subroots.unionByName(top)
        placed = ranked(stored(subroots, "subroots"), [], ["tree"])
        one = F.lit(None).cast("string").alias("tree")
        node = F.struct(F.col("digest"), F.col("tree").alias("group")).alias("node")
        self.upper = _climb(placed.select(one, F.col(RANK).cast("long").alias("idx"), node), "merkle_top")
        top = _tops(self.upper)[-1].first()
        self.root = top.digest if top else None

    def rows(self) -> DataFrame:
        """(id, leaf, subroot, path, folded): ``path`` from the leaf to the root, as what goes before and after its digest;
        ``folded`` the root that the other hash (or the leaf) leads to with the same siblings."""
        none = self.levels[0].sparkSession.range(1).select(F.lit(None).cast("string").alias("tree"), F.expr(f"cast(array() as {_PATH})").alias("path"))
        upper = _with_paths(self.upper, none, "merkle_top_paths")
        members = upper.select("alone", "path", _digests(F.col("members")).alias("digests"), F.posexplode("members").alias("slot", "member"))
        step = F.when(F.col("alone"), F.col("path")).otherwise(F.concat(F.array(_entry(F.col("digests"), F.col("slot"))), F.col("path")))
        above = stored(members.select(F.col("member.group").alias("tree"), step.alias("path"), F.col("member.digest").alias("subroot")), "subroot_paths")
        runs = _with_paths(self.levels, above, "merkle_paths")
        digests, path, alone = _digests(F.col("members")), F.col("path"), F.col("alone")

        def judged(member: Column, slot: Column) -> Column:
            own = F.when(alone, path).otherwise(F.concat(F.array(_entry(digests, slot)), path))
            start = F.coalesce(member["other"], member["digest"])
            siblings = F.array_join(F.transform(own, lambda s: F.concat(s["before"], s["after"])), "")
            return F.struct(
                member["id"].alias("id"), member["digest"].alias("leaf"), F.sha2(siblings, 256).alias("proof_sha256"), _fold(own, start).alias("folded")
            )

        return runs.select("subroot", F.explode(F.transform("members", judged)).alias("row")).select("row.*", "subroot")


def document_leaves(docs: DataFrame) -> DataFrame:
    """The leaf of every document, by source, and for the ids whose checksum 5 divides the hash after tampering: A-Z of the text lower-cased."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = F.when(tampered, leaf_hash(*fields, F.translate("text", upper, upper.lower())))
    return docs.select(
        F.col("source").cast("string").alias("tree"), F.col("doc_id").alias("id"), leaf_hash(*fields, F.col("text")).alias("leaf"), other.alias("other")
    )


def manifest(docs: DataFrame) -> DataFrame:
    """Every document's leaf, subroot, root, hashed proof, and whether its perhaps tampered text still leads to the root."""
    tree = Manifest(stored(document_leaves(docs), "leaves"))
    root = F.lit(tree.root).cast("string")
    return tree.rows().select(
        F.col("id").alias("doc_id"), "leaf", "subroot", root.alias("root"), "proof_sha256", F.col("folded").alias("folded_root"), (F.col("folded") == root).alias("verified")
    )
