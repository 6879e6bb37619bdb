"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosine, distributed components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, gathered, quoted, sliced
from .graph import connected_components

#: Members of one block of a bucket; a longer bucket is compared block by block in separate tasks.
BLOCK = 1024


def tables_for(rows: int, threshold: float, recall: float) -> tuple[int, int]:
    """(tables, bits): bits grow with the logarithm of the rows, so that unlike vectors seldom share a bucket, and as many
    tables as give a pair at the threshold the recall."""
    bits = min(40, max(6, math.ceil(math.log2(max(rows, 2))) + 4))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree))), bits


def codes_of(x: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    """(vectors, tables) sign codes; the hyperplanes are made anew from the seed wherever they are needed."""
    planes = np.random.default_rng((seed, x.shape[1])).standard_normal((x.shape[1], tables * bits))
    signs = (x @ planes > 0).reshape(len(x), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two that brings its largest component near 1: exact, and squares then stay finite."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


#: Codes have at most 40 bits.
MOST_CODES = 1 << 40


def width_of(bits: int) -> int:
    """Bytes that hold a code."""
    return -(-bits // 8)


def _coded(seed: int, tables: int, bits: int):
    """Adds the codes of all tables to each class of equal vectors, as numbers and as width_of(bits) bytes each, the highest first."""
    low = 8 - width_of(bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in sliced(batches, 1000):
            for _, rows in batch.groupby(batch["v"].map(len)):
                codes = codes_of(scaled(np.array(rows["v"].tolist(), np.float64)), tables, bits, seed)
                packed = codes.astype(">i8").view(np.uint8).reshape(*codes.shape, 8)[:, :, low:]
                yield rows[["cid", "n", "v"]].assign(codes=list(codes), packed=[p.tobytes() for p in packed])

    return run


#: Blocks of up to this many members are compared together, many blocks at a time.
SMALL = 24


def pairs_within(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of members (a before b) of each group, groups of one size at a time."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in np.unique(sizes):
        x, y = np.triu_indices(size, 1)
        at = starts[sizes == size]
        a.append((at[:, None] + x).reshape(-1))
        b.append((at[:, None] + y).reshape(-1))
    return np.concatenate(a), np.concatenate(b)


def labels_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member that each of n members is connected with by the pairs."""
    label = np.arange(n)
    while len(a):
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        least = least[least]
        if (least == label).all():
            break
        label = least
    return label


def _at_least(x: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the exact cosine of each pair reaches the threshold; 65,536 pairs at a time."""
    cut_ = range(0, len(a), 65536)
    dots = [np.einsum("ij,ij->i", x[a[i : i + 65536]], x[b[i : i + 65536]]) for i in cut_]
    return np.concatenate(dots or [np.zeros(0)]) / (lengths[a] * lengths[b]) >= threshold


def _blocks(threshold: float, width: int):
    """Rows come sorted by bucket and block pair; each yields the counts and links of its members.

    A pair counts in the first table in which its codes agree (codes are those of the tables before), so its count is right however
    many buckets it shares.
    """
    by = ["tab", "code", "dim", "lo", "hi"]

    def found(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        """Counts and links of whole blocks of vectors of one length; starts: where each block begins."""
        x = scaled(np.array(rows["v"].tolist(), np.float64))
        lengths, codes = np.sqrt((x * x).sum(axis=1)), rows["packed"].to_numpy()
        sizes = np.diff(np.append(starts, len(x)))
        few = sizes <= SMALL
        a, b = pairs_within(starts[few], sizes[few])
        ok = _at_least(x, lengths, a, b, threshold)
        pairs = [(a[ok], b[ok])]
        for i, m in zip(starts[~few], sizes[~few]):
            unit = x[i : i + m] / lengths[i : i + m, None]
            a, b = np.nonzero(np.triu(unit @ unit.T >= threshold - 1e-9, 1))
            ok = _at_least(x, lengths, a + i, b + i, threshold)
            pairs.append((a[ok] + i, b[ok] + i))
        a, b = (np.concatenate(p) for p in zip(*pairs))
        own, same = rows["own"].to_numpy(), (rows["lo"] == rows["hi"]).to_numpy()
        ok = same[a] | (own[a] != own[b])
        a, b = a[ok], b[ok]
        first = np.ones(len(a), bool)
        tabs = rows["tab"].to_numpy()[a]
        for tab in np.unique(tabs[tabs > 0]):
            mine = np.flatnonzero(tabs == tab)
            for i in range(0, len(mine), 65536):
                part = mine[i : i + 65536]
                members, at = np.unique(np.concatenate((a[part], b[part])), return_inverse=True)
                held = np.frombuffer(b"".join(codes[members]), np.uint8).reshape(len(members), tab, width)
                first[part] = (held[at[: len(part)]] != held[at[len(part) :]]).any(axis=2).all(axis=1)
        a, b = a[first], b[first]
        n, cid = rows["n"].to_numpy(), rows["cid"].to_numpy()
        count = (np.bincount(a, n[b], len(x)) + np.bincount(b, n[a], len(x))).astype(np.int64)
        hit = count > 0
        return pd.DataFrame({"cid": cid[hit], "add": count[hit], "hub": cid[labels_of(len(x), a, b)[hit]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            if rest is not None:
                batch = pd.concat([rest, batch], ignore_index=True)
            if not len(batch):
                continue
            key = batch[by].to_numpy()
            starts = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1))
            rest, whole, starts = batch.iloc[starts[-1] :], batch.iloc[: starts[-1]], starts[:-1]
            dims = whole["dim"].to_numpy()[starts] if len(starts) else starts
            for dim in np.unique(dims):
                keep = np.repeat(dims == dim, np.diff(np.append(starts, len(whole))))
                sizes = np.diff(np.append(starts, len(whole)))[dims == dim]
                yield found(whole[keep], np.cumsum(sizes) - sizes)
        if rest is not None and len(rest):
            yield found(rest, np.zeros(1, np.int64))

    return run


def embedding_components(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, recall: float = 0.9999,
    block: int = BLOCK, seed: int = 11,
) -> DataFrame:
    """One row per row of vectors: id_col, n_links, component_id, kept (id = component_id).

    Cosines are taken in double precision, of vectors scaled by a power of two, so that huge and tiny components count like others.
    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing and form components of their own; so do vectors of unlike length. Equal vectors are one class
    that counts with its size, so copies are never paired. Null ids: component of the class as for others, kept false. A pair exactly at
    the threshold is found with probability `recall`, a closer one with a higher. Other columns of vectors are left out.

    The index holds a class number and a code per table; vectors travel only to buckets that two or more classes share, and of buckets
    with the same members (a tight group is one in most tables) to the first alone. Buckets have the same members if their size and
    two 64-bit sums of members' hashes agree.
    """
    kind = vectors.schema[vector_col].dataType.simpleString()
    number = "float" if kind == "array<float>" else "double"
    rows = vectors.select(quoted(id_col).alias("id"), quoted(vector_col).cast(f"array<{number}>").alias("v"))
    fine = F.coalesce(
        F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0), F.lit(False)
    )
    rows = rows.withColumn("v", F.when(fine, F.transform("v", lambda c: c + F.lit(0.0).cast(number))))
    classes = rows.where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("cid"), "n", "least", "v"))  # numbers are kept from here on
    tables, bits = tables_for(classes.count(), threshold, recall)
    coded = cut(classes.select("cid", "n", "v").mapInPandas(_coded(seed, tables, bits), f"cid long, n long, v array<{number}>, codes array<long>, packed binary"))
    index = coded.select("cid", F.size("v").alias("dim"), F.posexplode("codes").alias("tab", "code"))
    members = [F.bit_xor(F.xxhash64("cid", F.lit(i))).alias(f"x{i}") for i in range(2)]
    sizes = index.groupBy("tab", "code", "dim").agg(F.count(F.lit(1)).alias("m"), *members).where("m > 1")
    first = F.min(F.col("tab").cast("long") * MOST_CODES + F.col("code"))  # one number, so that it is a hash aggregate
    sizes = sizes.groupBy("dim", "m", "x0", "x1").agg(first.alias("b"))
    sizes = sizes.select(F.expr(f"int(b div {MOST_CODES})").alias("tab"), (F.col("b") % MOST_CODES).alias("code"), "dim", "m")
    index = index.join(sizes, ["tab", "code", "dim"])
    parts = F.ceil(F.col("m") / block).cast("int")
    index = index.withColumn("own", F.pmod(F.xxhash64("cid"), parts).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), parts - 1), lambda o: F.struct(F.least(o, "own").alias("lo"), F.greatest(o, "own").alias("hi")))
    index = index.withColumn("p", F.explode(pairs)).select("tab", "code", "dim", "p.lo", "p.hi", "own", "cid")
    index = index.join(coded.drop("codes"), "cid").withColumn("packed", F.substr("packed", F.lit(1), F.col("tab") * width_of(bits)))  # those of the tables before
    by = ["tab", "code", "dim", "lo", "hi"]
    found = cut(gathered(index.select(*by, "own", "cid", "n", "packed", "v"), by).mapInPandas(_blocks(threshold, width_of(bits)), "cid long, add long, hub long"))
    counts = found.groupBy("cid").agg(F.sum("add").alias("others"))
    roots = connected_components(found, "cid", "hub").withColumnRenamed("node", "cid")
    classes = classes.join(counts, "cid", "left").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    groups = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    links = F.col("n") - 1 + F.coalesce("others", F.lit(0))
    classes = classes.join(groups, "root").select("v", links.alias("n_links"), "component_id")
    paired = rows.where("v IS NOT NULL").join(classes, "v").select("id", "n_links", "component_id")
    alone = rows.where("v IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return paired.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", kept.alias("kept"))
