"""Merkle manifest of a table: leaves by source, trees of 16 children, proofs, and folding from saved SHA-256 states."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, gathered, quoted, record_batches, row_tuples, text_key_of
from .numbering import placed

ARITY = 16
#: Levels that one task builds at once: 16**3 nodes, some 400 KB.
HEIGHT = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 (hex) of the fields, each as `-` if null, else its UTF-8 byte count, `:` and itself."""
    each = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*(each(c.cast("string")) for c in fields)), 256)


def levels_of(size: int) -> int:
    """Levels above `size` nodes until one is left."""
    n = 0
    while size > 1:
        size, n = -(-size // ARITY), n + 1
    return n


class Parent:
    """A node with the hash state before each child's slot, so that another child there costs itself and its right siblings only."""

    def __init__(self, children: list[bytes]):
        self.hexes = [c.hex().encode() for c in children]
        self.states, state = [], hashlib.sha256()
        for child in self.hexes:
            self.states.append(state.copy())
            state.update(child)
        self.digest = state.digest()
        self.after = [b"".join(self.hexes[i + 1 :]) for i in range(len(children))]

    def folded(self, slot: int, child: bytes) -> bytes:
        state = self.states[slot].copy()
        state.update(child.hex().encode())
        state.update(self.after[slot])
        return state.digest()

    def others(self, slot: int) -> bytes:
        return b"".join(self.hexes[:slot]) + self.after[slot]


def built(nodes: list[bytes], levels: int) -> tuple[list[list[Parent]], bytes]:
    """The parents of each of `levels` levels above some nodes, and what is left on top."""
    out = []
    for _ in range(levels):
        parents = [Parent(nodes[i : i + ARITY]) for i in range(0, len(nodes), ARITY)]
        out.append(parents)
        nodes = [p.digest for p in parents]
    return out, nodes[0]


def _packed_path(steps: list[tuple[int, list[bytes]]]) -> bytes:
    """Levels of a path, lowest first: slot, number of children, their digests."""
    return b"".join(bytes((slot, len(run))) + b"".join(run) for slot, run in steps)


def _steps(path: bytes) -> list[tuple[int, list[bytes]]]:
    out, at = [], 0
    while at < len(path):
        slot, n = path[at], path[at + 1]
        out.append((slot, [path[at + 2 + 32 * i : at + 34 + 32 * i] for i in range(n)]))
        at += 2 + 32 * n
    return out


def _chunks(rows: Iterator[tuple]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal (tree, chunk), their first two fields; a run is bounded by ARITY**HEIGHT and a path."""
    key, held = None, []
    for row in rows:
        if row[:2] != key:
            if held:
                yield key, held
            key, held = row[:2], []
        held.append(row)
    if held:
        yield key, held


def _tops(nodes: DataFrame) -> DataFrame:
    """(tree, size, pos, hash) HEIGHT levels up."""
    schema = pa.schema([("tree", pa.string()), ("size", pa.int64()), ("pos", pa.int64()), ("hash", pa.binary())])

    def run(batches):
        def rows():
            for (tree, chunk), held in _chunks(row_tuples(batches, "tree", "chunk", "size", "hash")):
                size = held[0][2]
                top = built([r[3] for r in held], min(HEIGHT, levels_of(size)))[1]
                yield tree, -(-size // ARITY**HEIGHT), chunk, top

        return record_batches(rows(), schema)

    rows = nodes.select("tree", F.floor(F.col("pos") / ARITY**HEIGHT).alias("chunk"), "size", "pos", "hash")
    return cut(gathered(rows, ["tree", "chunk"], ("pos",)).mapInArrow(run, "tree string, size long, pos long, hash binary"))


def _with_paths(nodes: DataFrame, above: DataFrame, work, schema: pa.Schema, types: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """work(held, steps, top) for each chunk of nodes: their rows, the path above the chunk and its subroot, which meet in one sorted stream."""
    none = {"pos": F.lit(-1).cast("long"), "size": F.lit(None).cast("long"), "hash": F.lit(None).cast("binary"), **{c: F.lit(None).cast(nodes.schema[c].dataType) for c in extra}}
    rows = nodes.select("tree", F.floor(F.col("pos") / ARITY**HEIGHT).alias("chunk"), "pos", "size", "hash", *extra, F.lit(None).cast("binary").alias("path"), F.lit(None).cast("binary").alias("subroot"))
    paths = above.select("tree", F.col("pos").alias("chunk"), *(c.alias(n) for n, c in none.items()), "path", "subroot")

    def run(batches):
        def out():
            for _, held in _chunks(row_tuples(batches, "tree", "chunk", "path", "subroot", "pos", "size", "hash", *extra)):
                first, held = held[0], held[1:]
                yield from work(held, _steps(first[2]), first[3])

        return record_batches(out(), schema)

    return gathered(rows.unionByName(paths), ["tree", "chunk"], ("pos",)).mapInArrow(run, types)


def _node_paths(held, steps, subroot):
    """(tree, pos, path, subroot) of nodes inside the tree."""
    parents, _ = built([r[6] for r in held], min(HEIGHT, levels_of(held[0][5])))
    for k, r in enumerate(held):
        own, at = [], k
        for level in parents:
            own.append((at % ARITY, [bytes.fromhex(x.decode()) for x in level[at // ARITY].hexes]))
            at //= ARITY
        yield r[0], r[4], _packed_path(own + steps), subroot


_PATHS = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("path", pa.binary()), ("subroot", pa.binary())])


def _climbed(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The node tables of each round from `nodes` up, and the last one: a row per tree."""
    out = [nodes]
    most = nodes.agg(F.max("size")).first()[0] or 0
    while True:
        out.append(_tops(out[-1]))
        most = -(-most // ARITY**HEIGHT)
        if most <= 1:
            return out[:-1], out[-1]


def _descended(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """Paths of the nodes of the lowest of `levels`, from those of the roots."""
    for nodes in reversed(levels):
        above = cut(_with_paths(nodes, above, _node_paths, _PATHS, "tree string, pos long, path binary, subroot binary"))
    return above


def manifest(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", others: tuple[str, ...] = ("lang", "n_chars"), text_col: str = "text",
    tampered: Column | None = None,
) -> DataFrame:
    """One row per row of docs: id_col, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of id, source, others and text. Leaves of a source ascend by id (null first; equal ids by leaf, so repeated rows are
    leaves of their own); of several nodes every 16 become one until the subroot is left; the subroots, by source (null first, bytewise), give the root
    likewise. Where `tampered` holds (default: 5 divides the CRC-32 of the decimal id), the check starts from the leaf of the text with A-Z
    lower-cased; folding takes up each parent's saved state before the child's slot and adds the new child and its right siblings. Null and empty
    texts have leaves like any other; an empty table gives no rows. Other columns are left out.

    Texts become digests before any shuffle. Leaves are placed by range, so a source of any size is spread over tasks; subtrees of 4096 leaves are
    built apart, and what is above them comes down as paths, a row per subtree.
    """
    key, text = quoted(id_col), quoted(text_col)
    if tampered is None:
        tampered = F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))
    fields = [key, quoted(source_col), *(quoted(c) for c in others)]
    other = F.when(tampered, F.unhex(leaf_digest([*fields, F.translate(text, _UPPER, _LOWER)])))
    leaves = docs.select(text_key_of(quoted(source_col)).alias("tree"), key.alias("id"), F.unhex(leaf_digest([*fields, text])).alias("hash"), other.alias("other"))
    leaves = placed(cut(leaves), "tree", ["id", "hash"], "pos")  # ranges are drawn from digests: texts are read once
    sizes = cut(leaves.groupBy("tree").agg(F.max("pos").alias("size")).select("tree", F.col("size") + 1))
    sizes = sizes.toDF("tree", "size")
    # the size is needed with a chunk's first node only, so one row per chunk meets it
    heads = leaves.where(F.col("pos") % ARITY**HEIGHT == 0).join(sizes, "tree").select("tree", "pos", "size")
    leaves = cut(leaves.join(heads, ["tree", "pos"], "left"))
    levels, subroots = _climbed(leaves)
    top = placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash"), "tree", ["name"], "pos")
    top = cut(top.crossJoin(F.broadcast(subroots.agg(F.count(F.lit(1)).alias("size")))))  # one row
    top_levels, root = _climbed(top)
    found = root.first()
    whole = found["hash"] if found else b""
    above = root.select("tree", "pos", F.lit(b"").alias("path"), F.lit(None).cast("binary").alias("subroot"))
    paths = _descended(top_levels, above).join(top.select("pos", "name", "hash"), "pos")
    above = _descended(levels[1:], paths.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("hash").alias("subroot")))

    def checked(held, steps, subroot):
        parents, _ = built([r[6] for r in held], min(HEIGHT, levels_of(held[0][5])))
        upper = [(slot, Parent(run)) for slot, run in steps]
        rest = b"".join(p.others(slot) for slot, p in upper)
        for k, r in enumerate(held):
            digest, at, proof = r[8] or r[6], k, hashlib.sha256()
            for level in parents:
                parent, slot = level[at // ARITY], at % ARITY
                proof.update(parent.others(slot))
                digest = parent.folded(slot, digest)
                at //= ARITY
            proof.update(rest)
            for slot, parent in upper:
                digest = parent.folded(slot, digest)
            yield r[7], r[6].hex(), subroot.hex(), whole.hex(), proof.hexdigest(), digest.hex(), digest == whole

    id_type = docs.select(key.alias("id")).schema["id"].dataType
    names = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    schema = pa.schema([("id", pa.string()), *((n, pa.string()) for n in names), ("verified", pa.bool_())])
    types = "id string, " + ", ".join(f"{n} string" for n in names) + ", verified boolean"
    rows = leaves.withColumn("id", F.col("id").cast("string"))
    out = _with_paths(rows, above, checked, schema, types, ("id", "other"))
    return out.select(F.col("id").cast(id_type).alias(id_col), *names, "verified")
