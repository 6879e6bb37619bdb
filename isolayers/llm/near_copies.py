"""Near copies by word shingles (Jaccard 0.8 and up), found in the byte-position index.

The SimHash index (simhash_dedup) links texts whose fingerprints are within 3 bits, if asked to; this module finds the copies that lie further apart.

Texts whose five-word shingle sets have Jaccard 0.8 differ in about 10 of 64 bits of a plain SimHash, which guarantees
no shared byte at all. So each byte position here takes the hash bits of a sample of its own: the one shingle that is
least in the position's order. Positional bytes then agree with a probability of the Jaccard similarity, and
count filtering works: lists under four positional bytes give candidates, the shared bytes of a pair are tallied
over all positions, and what reaches the minimum is verified on the sets of all shingles (as 64-bit hashes of their words).

Long lists are settled in two rounds, so that a group of copies doesn't give all its pairs: first each member meets its
closest partners and a hub, then all pairs of a list that the first round's links leave unconnected are compared. These
are tallied over more positions, so that fewer pairs below the similarity have to be verified; only members of such lists
get the longer sketches.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, distinct_texts, gathered, quoted, sliced, text_key
from .graph import connected_components
from .simhash_dedup import fingerprint_links, fingerprint_of
from .words import Hashes, mixed, normal, spans

POSITIONS, BAND = 48, 4
FINE_POSITIONS = 1024
#: Members of a list in one block of the second round.
BLOCK = 1024
LIST_LIMIT = 1024
_ODD = np.random.default_rng(7).integers(0, 2**64, POSITIONS, dtype=np.uint64) | np.uint64(1)
_FINE_ODD = np.random.default_rng(8).integers(0, 2**64, FINE_POSITIONS, dtype=np.uint64) | np.uint64(1)


def shingle_hashes(body: bytes, words: int) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles (A-Z lower-cased); a shorter text is one shingle, none if empty."""
    text = normal(body.lower())
    s, e = spans(text)
    if not len(s):
        return np.zeros(0, np.uint64)
    k = min(words, len(s))
    return np.unique(Hashes(text).of(s[: len(s) - k + 1], e[k - 1 :]))


def sketch(hashes: np.ndarray, odd: np.ndarray = _ODD) -> bytes:
    """One byte for each position; long texts are taken 1024 shingles at a time."""
    if not len(hashes):
        return bytes(len(odd))
    least = np.full(len(odd), 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[i : i + 1024, None] * odd).min(axis=0), out=least)
    return mixed(least).astype(np.uint8).tobytes()


def _sketches(words: int, odd: np.ndarray = _ODD, prints: bool = False):
    """(key, sketch), and with prints also fp, the SimHash fingerprint, from the same reading of the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in sliced(batches):
            found = pd.DataFrame({"key": batch["key"], "sketch": [sketch(shingle_hashes(b, words), odd) for b in batch["body"]]})
            yield found.assign(fp=np.array([fingerprint_of(b) for b in batch["body"]], np.int64)) if prints else found

    return run


def _least(positions: int, similarity: float) -> int:
    """Shared positions that a pair at the similarity reaches but for a chance of 3.5 deviations."""
    return max(1, int(positions * (similarity - 3.5 * (similarity * (1 - similarity) / positions) ** 0.5)))


#: Lists up to this length give all their pairs in the first round.
SMALL_LIST = 16


def partners(own: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a list's members, by the positional bytes that they share (`least` at the fewest).

    All pairs of a short list. In a longer one each member has its two closest earlier members and the hub,
    the member nearest to the most frequent byte of each position (for edited copies that is the original).
    """
    n = len(own)
    if n <= SMALL_LIST:
        a, b = np.tril_indices(n, -1)
        ok = (own[a] == own[b]).sum(axis=1) >= least
        return a[ok], b[ok]
    usual = np.array([np.bincount(own[:, p], minlength=256).argmax() for p in range(own.shape[1])], np.uint8)
    hub = int((own == usual).sum(axis=1).argmax())
    with_hub = np.flatnonzero((own == own[hub]).sum(axis=1) >= least)
    a, b = [with_hub], [np.full(len(with_hub), hub)]
    for k in range(1, n):
        shared = (own[:k] == own[k]).sum(axis=1)
        near = np.argsort(-shared, kind="stable")[:2]
        near = near[shared[near] >= least]
        a.append(np.full(len(near), k))
        b.append(near)
    a, b = np.concatenate(a), np.concatenate(b)
    return a[a != b], b[a != b]


def _whole_groups(by: list[str], found):
    """Applies `found` to whole groups; rows come sorted by group, and the last group waits for the next batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            if rest is not None:
                batch = pd.concat([rest, batch], ignore_index=True)
            if not len(batch):
                continue
            open_ = (batch[by] == batch[by].iloc[-1]).all(axis=1).to_numpy()
            rest, whole = batch[open_], batch[~open_].reset_index(drop=True)
            if len(whole):
                yield found(whole)
        if rest is not None and len(rest):
            yield found(rest.reset_index(drop=True))

    return run


def _once(x: np.ndarray, y: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Whether the bands that list the pairs of sketches (x, y) are the first ones that they share: of all lists of a pair only one makes it.

    own marks the bands of each pair's list.
    """
    shared = (x == y).reshape(-1, POSITIONS // BAND, BAND).all(axis=2)
    first = shared & (shared.cumsum(axis=1) <= own.sum(axis=1, keepdims=True))
    return (first == own).all(axis=1)


def _best_partners(least: int, sets: list[tuple[int, ...]]):
    """Pairs of the whole lists in some rows; slot is the number of a list's set of bands. A pair comes from the first list that it shares."""
    marked = np.array([[b in chosen for b in range(POSITIONS // BAND)] for chosen in sets])

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        lists = rows["list"].to_numpy()
        cuts = np.flatnonzero(lists[1:] != lists[:-1]) + 1
        keys = rows["key"].to_numpy()
        bytes_ = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(-1, POSITIONS)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in zip([0, *cuts], [*cuts, len(rows)]):
            x, y = partners(bytes_[i:j], least)
            a.append(i + x)
            b.append(i + y)
        a, b = np.concatenate(a), np.concatenate(b)
        ok = _once(bytes_[a], bytes_[b], marked[rows["slot"].to_numpy()[a]])
        a, b = a[ok], b[ok]
        return pd.DataFrame({"a": keys[np.maximum(a, b)], "b": keys[np.minimum(a, b)]}).drop_duplicates()

    return found


def _candidates(sketches: DataFrame, least: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of keys, and the lists (list, key) whose pairs are not all among them.

    Lists over the limit are split by the bytes of two, then three bands; the longest are paired with a hub. All of them lie
    within the lists of one band, so the latter, of any length, hold all pairs that the second round has to settle.
    """
    bands = [F.substring("sketch", 1 + BAND * i, BAND) for i in range(POSITIONS // BAND)]
    pairs, partly, rows, longest = None, None, sketches.withColumn("slot", F.lit(0)), [()]
    for level in (1, 2, 3):
        sets = list(combinations(range(len(bands)), level))
        hashed = lambda i, chosen: F.struct(F.lit(i).alias("slot"), F.xxhash64(F.lit(i), *(bands[b] for b in chosen)).alias("list"))
        # a pair comes from its first bands, so a long list of these is split by the bands after them and a member's other sets are not needed
        lists = F.array_compact(F.array(*(F.when(F.col("slot") == longest.index(chosen[:-1]), hashed(i, chosen)) for i, chosen in enumerate(sets))))
        # sketches stay out of the index and come to the members of lists that two or more share
        index = rows.select("key", F.explode(lists).alias("e")).select("key", "e.slot", "e.list")
        counts = index.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        index = cut(index.join(counts, "list").select("list", "slot", "key", "n"))
        short = gathered(index.where(F.col("n") <= limit).join(sketches, "key").select("list", "slot", "key", "sketch"), ["list"], ("key",))
        found = short.mapInPandas(_whole_groups(["list"], _best_partners(least, sets)), "a binary, b binary")
        pairs = found if pairs is None else pairs.unionByName(found)
        if partly is None:
            partly = index.where(F.col("n") > min(SMALL_LIST, limit)).select("list", "key")
        longer = index.where(F.col("n") > limit)
        if longer.isEmpty():
            return pairs, partly
        rows, longest = longer.select("key", "slot").join(sketches, "key"), sets
    hubs = longer.groupBy("list").agg(F.min("key").alias("b"))
    pairs = pairs.unionByName(longer.join(hubs, "list").select(F.col("key").alias("a"), "b").where("a != b").distinct())
    return pairs, partly


def _apart(least: int):
    """Pairs of different roots that share at least `least` positional bytes, between the open rows of a block and its others."""

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        blocks = rows[["list", "px", "py"]].to_numpy()
        cuts = np.flatnonzero((blocks[1:] != blocks[:-1]).any(axis=1)) + 1
        keys, roots, open_ = rows["key"].to_numpy(), pd.factorize(rows["root"])[0], rows["open"].to_numpy()
        bytes_ = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(rows), -1)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in zip([0, *cuts], [*cuts, len(rows)]):
            others = i + np.flatnonzero(~open_[i:j])
            theirs = bytes_[others]
            for k in i + np.flatnonzero(open_[i:j]):
                near = others[((theirs == bytes_[k]).sum(axis=1) >= least) & (roots[others] != roots[k])]
                a.append(np.full(len(near), k))
                b.append(near)
        a, b = keys[np.concatenate(a)], keys[np.concatenate(b)]
        return pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b)}).drop_duplicates()

    return found


def _open_lists(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """The members (list, key, root) of lists with more than one root, with the list's most frequent root (usual) and
    the numbers of blocks of its other members (nx) and of all (ny)."""
    rows = lists.join(roots.withColumnRenamed("node", "key"), "key", "left").select("list", "key", F.coalesce("root", "key").alias("root"))
    sizes = rows.groupBy("list", "root").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("list").agg(F.max_by("root", F.struct("n", "root")).alias("usual"), F.sum("n").alias("n"), F.max("n").alias("top"))
    parts = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = sizes.where("n > top").select("list", "usual", parts(F.col("n") - F.col("top")).alias("nx"), parts(F.col("n")).alias("ny"))
    return rows.join(sizes, "list")


def _unconnected(rows: DataFrame, sketches: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) of a list's members that share at least `least` positional bytes and have different roots.

    rows are those of _open_lists. Members with the usual root are not compared with each other, so a group that is
    connected already costs nothing, and one that isn't costs its unconnected members times its length. Each
    block of unconnected members meets each block of all members in a task, so none holds a long list.
    """
    own = lambda n: F.array(F.pmod(F.xxhash64("key"), F.col(n)).cast("int"))
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)

    def dealt(df: DataFrame, px: Column, py: Column, open_: bool) -> DataFrame:
        dealt_x = df.select("list", "key", "root", F.explode(px).alias("px"), py.alias("py"))
        return dealt_x.select("list", "key", "root", "px", F.explode("py").alias("py"), F.lit(open_).alias("open"))

    both = dealt(rows.where("root != usual"), own("nx"), each("ny"), True).unionByName(dealt(rows, each("nx"), own("ny"), False))
    blocks = gathered(both.join(sketches, "key"), ["list", "px", "py"])
    return blocks.mapInPandas(_whole_groups(["list", "px", "py"], _apart(least)), "a binary, b binary").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of keys whose shingle sets have Jaccard >= similarity."""
    named = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    needed = texts.select("key", "body").join(named, "key")

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in sliced(batches):
            ok = []
            for x, y in zip(batch["body_a"], batch["body_b"]):
                x, y = shingle_hashes(x, shingle_words), shingle_hashes(y, shingle_words)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.loc[ok, ["a", "b"]]

    side = lambda s: needed.select(F.col("key").alias(s), F.col("body").alias(f"body_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(verified, "a binary, b binary")


def fingerprint_pairs(prints: DataFrame) -> DataFrame:
    """Links (a, b) of the distinct texts (key, fp) whose components are those of all pairs of fingerprints within 3 bits, by the SimHash index."""
    first = prints.groupBy("fp").agg(F.min("key").alias("b"))
    of = lambda s: first.select(F.col("fp").alias(f"fp_{s}"), F.col("b").alias(s))
    far = fingerprint_links(first.select("fp")).toDF("fp_a", "fp_b").join(of("a"), "fp_a").join(of("b"), "fp_b").select("a", "b")
    return prints.join(first, "fp").where("key != b").select(F.col("key").alias("a"), "b").unionByName(far)


def similar_groups(
    texts: DataFrame, shingle_words: int = 5, similarity: float = 0.8, list_limit: int = LIST_LIMIT, by_fingerprint: bool = False,
) -> DataFrame:
    """(node, root) of the distinct texts (key, body) that have a link: Jaccard >= similarity on the sets of shingle hashes.

    With by_fingerprint, texts whose SimHash fingerprints are within 3 bits are linked too. Every pair that shares a list and the
    least number of positional bytes is verified, or connected by such links.
    """
    kinds = "key binary, sketch binary" + ", fp long" * by_fingerprint
    sketches = cut(texts.select("key", "body").mapInPandas(_sketches(shingle_words, prints=by_fingerprint), kinds))
    close = fingerprint_pairs(sketches.select("key", "fp")) if by_fingerprint else None
    sketches = sketches.select("key", "sketch")
    pairs, partly = _candidates(sketches, _least(POSITIONS, similarity), list_limit)
    pairs, partly = cut(pairs.distinct()), cut(partly)
    links = _verified(pairs, texts, shingle_words, similarity)
    # components of both kinds of links at once
    links = links.unionByName(close) if close else links
    roots = connected_components(links, "a", "b")
    rows = cut(_open_lists(partly, roots))
    # the texts of open lists travel once, for their longer sketches and for what is verified of them
    open_texts = cut(texts.select("key", "body").join(rows.select("key").distinct(), "key"))
    fine = cut(open_texts.mapInPandas(_sketches(shingle_words, _FINE_ODD), "key binary, sketch binary"))
    more = _unconnected(rows, fine, _least(FINE_POSITIONS, similarity))
    more = cut(more.join(pairs, ["a", "b"], "left_anti"))
    if more.isEmpty():
        return roots
    links = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return connected_components(links.unionByName(_verified(more, open_texts, shingle_words, similarity)), "a", "b")


def keep_one_of_each_group(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8,
    list_limit: int = LIST_LIMIT, by_fingerprint: bool = False,
) -> DataFrame:
    """docs without near copies: of each group of linked texts the row with the smallest id stays.

    With by_fingerprint, texts whose SimHash fingerprints are within 3 bits are linked too, and shingle sets find what lies further apart.
    Null and empty texts are copies of each other. Rows without an id stay, as do rows that repeat the kept id within the group; an
    id that other groups have too is judged in each by itself.
    """
    texts = distinct_texts(docs, text_col)
    key = text_key(F.coalesce(quoted(text_col).cast("binary"), F.lit(b"")))
    rows = docs.select(quoted(id_col).alias("_id"), key.alias("key"))
    roots = similar_groups(texts, shingle_words, similarity, list_limit, by_fingerprint).withColumnRenamed("node", "key")
    rows = cut(rows.join(roots, "key", "left").select("_id", "key", F.coalesce("root", "key").alias("root")))
    first = rows.groupBy("root").agg(F.min("_id").alias("first"))
    gone = rows.join(first, "root").where("_id != first").select(F.col("_id").alias("_gone_id"), F.col("key").alias("_gone_key")).distinct()
    return docs.join(gone, (quoted(id_col) == F.col("_gone_id")) & (key == F.col("_gone_key")), "left_anti")
