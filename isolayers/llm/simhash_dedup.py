"""SimHash near-dedup over a byte-position inverted index with count filtering.

Fingerprints that differ in at most 3 of 64 bits differ in at most 3 of 8 bytes, so they share at least 5
positional bytes, and at least 3 of any 6 positions. The index therefore lists fingerprints under each triple
of (position, byte) taken from the first six positions; the pairs of a list have their shared positional bytes tallied,
those with 5 or more stay, and the differing bits of these are counted. A list too long for that is split by two more
shared positions (5 of 8 must agree); one that is still too long is settled by flipping bits of the 24 that are left,
at a cost in proportion to its length. Only links that keep the graph connected leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, gathered, quoted
from .graph import connected_components

SEED = 42
LIST_LIMIT = 2048
_TRIPLES = list(combinations(range(6), 3))


def fingerprint_of(body: bytes | None, shingle_words: int = 3) -> int:
    """SimHash (signed 64-bit) of a text: words [^\\x20\\x09-\\x0D]+, A-Z lower-cased, XXH64 of joined shingles."""
    words = (body or b"").lower().split()
    if not words:
        return 0
    text, k = b" ".join(words), shingle_words
    if len(words) <= k:
        hashes = [xxhash.xxh64_intdigest(text, SEED)]
    else:
        starts, at = [], 0
        for w in words:
            starts.append(at)
            at += len(w) + 1
        ends = [*(x - 1 for x in starts[k:]), len(text)]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(text[a:b], SEED) for a, b in zip(starts, ends)]
    counts = np.zeros(64, np.int64)
    packed = np.array(hashes, ">u8")
    for i in range(0, len(packed), 65536):
        counts += np.unpackbits(packed[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text_col: str, out: str, shingle_words: int = 3) -> DataFrame:
    """docs with the fingerprint as a long column; null and empty texts have fingerprint 0."""

    @F.pandas_udf("long")
    def fingerprint(body: pd.Series) -> pd.Series:
        return body.map(lambda b: fingerprint_of(b, shingle_words)).astype("int64")

    return docs.withColumn(out, fingerprint(F.coalesce(quoted(text_col).cast("binary"), F.lit(b""))))


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(255)


def _under(fp: Column, positions: tuple[int, ...]) -> Column:
    mask = sum(255 << (8 * p) for p in positions)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def near_links(fps: np.ndarray, limit: int = 3) -> np.ndarray:
    """(k, 2) links that connect whatever pairs of one list within `limit` bits connect; blocks bound the memory."""
    n = len(fps)
    label = np.arange(n)
    own = fps.view(np.uint8).reshape(n, 8)
    pairs = []
    for i in range(0, n, 256):
        shared = np.zeros((min(256, n - i), n), np.uint8)
        for p in range(8):
            shared += own[i : i + 256, p, None] == own[None, :, p]
        a, b = np.nonzero(shared >= 8 - limit)
        a += i
        a, b = a[a < b], b[a < b]
        near = np.bitwise_count(fps[a] ^ fps[b]) <= limit
        pairs.append(np.stack((a[near], b[near]), 1))
    links = np.concatenate(pairs)
    while True:  # least label among neighbours, until it settles
        least = label.copy()
        np.minimum.at(least, links[:, 0], label[links[:, 1]])
        np.minimum.at(least, links[:, 1], label[links[:, 0]])
        least = least[least]
        if (least == label).all():
            break
        label = least
    tied = np.flatnonzero(label != np.arange(n))
    return np.stack((fps[tied], fps[label[tied]]), 1)


def _list_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of whole lists; rows come sorted by list, and the last one waits for the next batch."""
    rest = None

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        fps = rows["fp"].to_numpy().astype(np.int64).view(np.uint64)
        where, key = rows["slot"].to_numpy(), rows["bytes"].to_numpy()
        cuts = np.flatnonzero((np.diff(where) != 0) | (np.diff(key) != 0)) + 1
        out = [near_links(x) for x in np.split(fps, cuts) if len(x) > 1]
        links = np.concatenate(out).view(np.int64) if out else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})

    for batch in batches:
        if rest is not None:
            batch = pd.concat([rest, batch], ignore_index=True)
        if not len(batch):
            continue
        open_ = ((batch["slot"] == batch["slot"].iloc[-1]) & (batch["bytes"] == batch["bytes"].iloc[-1])).to_numpy()
        rest, whole = batch[open_], batch[~open_]
        if len(whole):
            yield found(whole)
    if rest is not None and len(rest):
        yield found(rest)


def _lists(index: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Links of the lists with 2 to `limit` entries, and the rows of the longer lists."""
    counts = index.groupBy("slot", "bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    index = index.join(counts, ["slot", "bytes"])
    short = gathered(index.where(F.col("n") <= limit).select("slot", "bytes", "fp"), ["slot", "bytes"])
    links = short.mapInPandas(_list_links, "a long, b long")
    return links, index.where(F.col("n") > limit).select("slot", "bytes", "fp")


def _flips(free: tuple[int, ...]) -> list[tuple[int, int]]:
    """(mask, bits flipped) for all ways to flip at most 2 bits of the free positions."""
    bits = [8 * p + i for p in free for i in range(8)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [(0, 0), *((signed(1 << i), 1) for i in bits), *((signed((1 << i) | (1 << j)), 2) for i, j in combinations(bits, 2))]


def fingerprint_links(fps: DataFrame, list_limit: int = LIST_LIMIT) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct fingerprints (column fp) within 3 bits."""
    fp = F.col("fp")
    entries = F.array(*(F.struct(F.lit(i).alias("slot"), _under(fp, t).alias("bytes")) for i, t in enumerate(_TRIPLES)))
    links, long_ = _lists(fps.select("fp", F.explode(entries).alias("e")).select("e.slot", "e.bytes", "fp"), list_limit)
    long_ = cut(long_)
    if long_.isEmpty():
        return links
    fives = list(combinations(range(8), 5))
    more = [
        F.when(
            F.array_contains(F.lit([i for i, t in enumerate(_TRIPLES) if set(t) <= set(five)]), F.col("slot")),
            F.struct(F.lit(j).alias("slot"), _under(fp, five).alias("bytes")),
        )
        for j, five in enumerate(fives)
    ]
    five_index = long_.select("fp", F.explode(F.array_compact(F.array(*more))).alias("e")).select("e.slot", "e.bytes", "fp").distinct()
    more_links, longer = _lists(five_index, list_limit)
    links = links.unionByName(more_links)
    longer = cut(longer)
    if longer.isEmpty():
        return links
    rows = [(j, m, c) for j, five in enumerate(fives) for m, c in _flips(tuple(p for p in range(8) if p not in five))]
    flips = fps.sparkSession.createDataFrame(rows, "slot int, m long, c int")  # 56 x 301 rows, whatever the input
    seen = longer.join(F.broadcast(flips), "slot").select("slot", fp.bitwiseXOR(F.col("m")).alias("to"), "fp", "c")
    near = F.min(F.when(F.col("c") < 2, fp))  # two fingerprints meet within 3 bits if one of them flipped at most one
    hubs = seen.groupBy("slot", "to").agg(near.alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1 AND hub IS NOT NULL")
    return links.unionByName(
        seen.join(hubs, ["slot", "to"]).where("fp != hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()
    )


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", list_limit: int = LIST_LIMIT) -> DataFrame:
    """One row per row of docs: id_col, fingerprint (16 hex digits), component_id (smallest id reachable by links).

    Rows with the same fingerprint always link, those of empty and null texts (fingerprint 0) included; repeated rows
    come back repeated. Null ids get a component like any row; it is null if no row of it has an id. Other columns are left out.
    """
    prints = cut(fingerprints(docs.select(quoted(id_col).alias("_id"), quoted(text_col).alias("_text")), "_text", "fp").select("_id", "fp"))
    classes = prints.groupBy("fp").agg(F.min("_id").alias("least"))
    roots = connected_components(fingerprint_links(classes.select("fp"), list_limit), "a", "b")
    classes = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    groups = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classes.join(groups, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
