"""Merkle manifest of a table: one tree of SHA-256 digests per group of rows, and one over their roots.

A node is the hash of up to eight children, each the 64 hexadecimal digits of a digest. While a
parent is hashed, the state before each child slot is copied and kept. To learn what the root
becomes when one leaf is replaced, folding resumes the state before the leaf's slot with the
replacement and the siblings to its right, and so on upwards; siblings to the left are never
hashed again.

Trees are cut into blocks of ``LEVELS`` levels of nodes. Digests travel up from block to block, then
the paths above each block travel down, so that no task sees more than a block and one path.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedscape.operators.ordering import running_totals
from seedscape.scratch import materialize

#: Children of a node, and levels of nodes in a block.
ARITY, LEVELS = 8, 3
#: Left and right siblings of a node, level by level, as hexadecimal digits.
PATH = "array<struct<left:string,right:string>>"


def leaf_digest(columns: Sequence[Column]) -> Column:
    """Digest of a row: each value as ``-`` if null, else its number of UTF-8 bytes, a colon and the value."""
    text = [c.cast("string") for c in columns]
    parts = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in text]
    return F.sha2(F.concat(*parts), 256)


class Block:
    """A piece of a tree: its digests level by level, and the hash state before every child slot."""

    def __init__(self, digests: list[bytes], n: int, levels: int) -> None:
        """``n``: nodes of the whole tree on the level of ``digests``; a single one has no parent."""
        self.digests, self.states = [digests], []
        while n > 1 and len(self.states) < levels:
            states, above = [], []
            for at in range(0, len(self.digests[-1]), ARITY):
                state = sha256()
                for digest in self.digests[-1][at : at + ARITY]:
                    states.append(state.copy())
                    state.update(digest)
                above.append(state.hexdigest().encode())
            self.states.append(states)
            self.digests.append(above)
            n = -(-n // ARITY)

    def siblings(self, at: int) -> Iterator[tuple[bytes, bytes]]:
        """What stands left and right of node ``at`` under its parent, then of the parent, and so on."""
        for digests in self.digests[: len(self.states)]:
            first = at - at % ARITY
            yield b"".join(digests[first:at]), b"".join(digests[at + 1 : first + ARITY])
            at //= ARITY

    def fold(self, at: int, digest: bytes, rights: Sequence[bytes]) -> bytes:
        """The top digest with ``digest`` in the place of node ``at``, from the kept states and right siblings."""
        for states, right in zip(self.states, rights):
            digest = _resumed(states[at], digest, right)
            at //= ARITY
        return digest


def _resumed(state, digest: bytes, right: bytes) -> bytes:
    state = state.copy()
    state.update(digest + right)
    return state.hexdigest().encode()


def _sorted(table: pa.Table) -> tuple[pa.Table, list[bytes]]:
    table = table.sort_by("pos")
    return table, [d.encode() for d in table["digest"].to_pylist()]


def _up(levels: int):
    """The root of a block, as a node of the level above it."""

    def run(table: pa.Table) -> pa.Table:
        table, digests = _sorted(table)
        first, n, block = table.slice(0, 1), table["n"][0].as_py(), ARITY**levels
        top = Block(digests, n, levels).digests[-1][0].decode()
        above = {"pos": pa.array([first["pos"][0].as_py() // block]), "digest": pa.array([top]), "n": pa.array([-(-n // block)])}
        return pa.table({"tree": first["tree"]} | above)

    return run


def _with_paths(nodes: pa.Table, above: pa.Table, levels: int):
    """The sorted nodes of a block, the block, the states and right siblings above it, and the whole path of each node."""
    nodes, digests = _sorted(nodes)
    block = Block(digests, nodes["n"][0].as_py(), levels)
    upper = [(step["left"].encode(), step["right"].encode()) for step in above["path"][0].as_py()]
    states = [(sha256(left), right) for left, right in upper]
    return nodes, block, states, [[*block.siblings(at), *upper] for at in range(len(digests))]


def _path_array(paths: list[list[tuple[bytes, bytes]]]) -> pa.Array:
    ends = [0]
    for path in paths:
        ends.append(ends[-1] + len(path))
    sides = [pa.array([step[side].decode() for path in paths for step in path], pa.string()) for side in (0, 1)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(sides, names=["left", "right"]))


def _down(levels: int):
    """Every node with the path from it to the root."""

    def run(nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes, _, _, paths = _with_paths(nodes, above, levels)
        return pa.table({"tree": nodes["tree"], "pos": nodes["pos"], "digest": nodes["digest"], "path": _path_array(paths)})

    return run


def _down_to_leaves(levels: int):
    """Every leaf with its path, and the root that its replacement folds to."""

    def run(nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes, block, states, paths = _with_paths(nodes, above, levels)
        folded = []
        for at, replacement in enumerate(nodes["replacement"].to_pylist()):
            digest = block.fold(at, replacement.encode(), [right for _, right in paths[at]])
            for state, right in states:
                digest = _resumed(state, digest, right)
            folded.append(digest.decode())
        made = {"row": nodes["row"], "leaf": nodes["digest"]}
        for name in ("subroot", "root"):
            made[name] = pa.array([above[name][0].as_py()] * len(nodes))
        return pa.table(made | {"proof": _path_array(paths), "folded_root": pa.array(folded)})

    return run


def _climb(nodes: DataFrame, n: int, levels: int) -> list[DataFrame]:
    """``nodes`` (tree, pos, digest, n) and the tables of block roots above them, up to one node per tree."""
    tiers = [nodes]
    while n > 1:
        dealt = tiers[-1].select("tree", "pos", "digest", "n").groupBy("tree", F.shiftright("pos", 3 * levels))
        tiers.append(materialize(dealt.applyInArrow(_up(levels), "tree string, pos long, digest string, n long"), "nodes"))
        n = -(-n // ARITY**levels)
    return tiers


def _descend(nodes: DataFrame, above: DataFrame, fn, schema: str, levels: int) -> DataFrame:
    """Meet the blocks of ``nodes`` with the paths of their roots in ``above``."""
    dealt = nodes.groupBy("tree", F.shiftright("pos", 3 * levels)).cogroup(above.groupBy("tree", F.col("pos")))
    return dealt.applyInArrow(fn(levels), schema)


def manifest(
    docs: DataFrame,
    columns: Sequence[str],
    group_col: str,
    order_col: str,
    replaced: Mapping[str, Column] | None = None,
    keep: Sequence[str] = (),
    levels: int = LEVELS,
) -> DataFrame:
    """The ``keep`` columns of every row with its ``leaf``, the ``subroot`` of its group, the ``root``, its ``proof`` and
    ``folded_root``.

    A leaf is the digest of ``columns``. Leaves of a group ascend by ``order_col``, equal ones by their digest, null
    first; groups ascend by UTF-8 bytes, null first, and null is a group of its own. ``proof`` holds the left and right
    siblings from the leaf up to the root; a row alone has none. ``folded_root`` is the root that follows from the proof
    if the columns in ``replaced`` had these values instead; without any it equals ``root``. Very long texts are hashed by
    Spark where they are and never travel. Repeated rows are leaves of their own. No rows give no rows. Columns that
    are not named take no part, whatever their names.
    """
    changed = [(replaced or {}).get(c, F.col(c)) for c in columns]
    leaves = docs.select(
        F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.lit(0).alias("none")).alias("row"),
        F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("tree"),
        F.col(order_col).alias("order"),
        leaf_digest([F.col(c) for c in columns]).alias("digest"),
        leaf_digest(changed).alias("replacement"),
    )
    placed = running_totals(leaves, [F.col("order"), F.col("digest")], by=["tree"])
    numbered = placed.select("tree", (F.col("rank") - 1).alias("pos"), "digest", F.col("n_rows").alias("n"), "replacement", "row")
    base = materialize(numbered, "leaves")
    trees = _climb(base, base.agg(F.max("n")).first()[0] or 0, levels)

    order = running_totals(trees[-1].select("tree", "digest"), [F.col("tree")])
    subroots = materialize(
        order.select(F.lit("").alias("tree"), (F.col("rank") - 1).alias("pos"), "digest", F.col("n_rows").alias("n"), F.col("tree").alias("of")),
        "subroots",
    )
    forest = _climb(subroots, subroots.count(), levels)
    steps = "tree string, pos long, digest string, path " + PATH
    above = forest[-1].select("tree", "pos", F.col("digest").alias("root"), F.expr(f"cast(array() as {PATH})").alias("path"))
    root = (above.first() or {"root": None})["root"]
    for nodes in reversed(forest[:-1]):
        above = materialize(_descend(nodes.select("tree", "pos", "digest", "n"), above.select("tree", "pos", "path"), _down, steps, levels), "paths")
    named = subroots.join(above.select("pos", "path"), "pos")
    above = named.select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"))
    for nodes in reversed(trees[1:-1]):
        own = above.select("tree", "subroot").distinct()
        below = _descend(nodes.select("tree", "pos", "digest", "n"), above.select("tree", "pos", "path"), _down, steps, levels)
        above = materialize(below.join(own, "tree").select("tree", "pos", "path", "subroot"), "paths")
    return _kept(_descend(base, above.withColumn("root", F.lit(root).cast("string")), _down_to_leaves, _leaf_schema(base), levels), keep)


def _leaf_schema(base: DataFrame) -> str:
    row = base.schema["row"].dataType.simpleString()
    return f"row {row}, leaf string, subroot string, root string, proof {PATH}, folded_root string"


def _kept(found: DataFrame, keep: Sequence[str]) -> DataFrame:
    return found.select(*[F.col(f"row.k{i}").alias(c) for i, c in enumerate(keep)], "leaf", "subroot", "root", "proof", "folded_root")


def proof_digest(proof: str = "proof") -> Column:
    """One digest of all siblings of a proof, bottom to top and left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), ""), 256)
