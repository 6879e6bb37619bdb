"""Packing into optimal length buckets, with token-budget batches inside each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, quoted
from .numbering import hash_parts, numbered


def n_words(text: str) -> Column:
    """Number of words ([^\\x20\\x09-\\x0D]+) of a text column; null counts as empty."""
    return F.size(F.filter(F.split(F.coalesce(quoted(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("int")


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` ranges of the lengths (ascending) with the least padding in all.

    Dynamic programme over the histogram; as the padding of a range satisfies the quadrangle inequality, the best cut
    moves one way only, and each layer is solved by halving: O(buckets * n * log n).
    """
    n = len(lengths)
    if not n:
        return []
    lengths, counts = lengths.astype(np.float64), counts.astype(np.float64)
    rows = np.concatenate(([0.0], np.cumsum(counts)))
    tokens = np.concatenate(([0.0], np.cumsum(counts * lengths)))

    def cost(i, j):  # padding if lengths i..j (inclusive) pad to lengths[j]
        return lengths[j] * (rows[j + 1] - rows[i]) - (tokens[j + 1] - tokens[i])

    best = cost(0, np.arange(n))
    cuts = []
    for _ in range(1, min(buckets, n)):
        now, at = np.full(n, np.inf), np.zeros(n, np.int64)
        now[0] = 0.0
        todo = [(1, n - 1, 1, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(a, min(mid, b) + 1)
            c = best[i - 1] + cost(i, mid)
            k = int(c.argmin())
            now[mid], at[mid] = c[k], i[k]
            todo += [(lo, mid - 1, a, int(i[k])), (mid + 1, hi, int(i[k]), b)]
        cuts.append(at)
        best = now
    out, j = [], n - 1
    for at in reversed(cuts):
        out.append(int(lengths[j]))
        j = int(at[j]) - 1
        if j < 0:
            return out[::-1]
    out.append(int(lengths[j]))
    return out[::-1]


def packed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 12, budget: int = 16384,
    part: Column | None = None, order: list[Column] | None = None,
) -> DataFrame:
    """One row per row of docs: id_col, n_tokens, bucket, bucket_tokens (padded length), batch (in the bucket), place.

    A batch holds budget // bucket_tokens rows, one at least, so that padded it keeps the budget unless a single
    text is over it. Rows take their places by part and order (default: by a hash of the id). Only the histogram of lengths, whose
    size the longest text bounds, reaches the driver. Null and empty texts have 0 tokens and form bucket 0 with the shortest.
    Repeated rows and rows without an id take places of their own. Other columns are left out.
    """
    keep = [quoted(id_col).alias("_id"), n_words(text_col).alias("n_tokens")]
    key = quoted(id_col)
    rows = docs.select(*keep, (part if part is not None else hash_parts(docs, key)).alias("_in"),
                       F.struct(*(order or [F.xxhash64(key), key])).alias("_by"))
    rows = cut(rows)  # short rows: the words of each text are counted once
    found = rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).orderBy("n_tokens").collect()
    bounds = best_bounds(np.array([r[0] for r in found]), np.array([r[1] for r in found]), buckets)
    bucket, size = F.lit(None).cast("int"), F.lit(None).cast("int")
    for i, top in reversed(list(enumerate(bounds))):
        bucket = F.when(F.col("n_tokens") <= top, i).otherwise(bucket)
        size = F.when(F.col("n_tokens") <= top, top).otherwise(size)
    rows = rows.withColumn("bucket", bucket).withColumn("bucket_tokens", size)
    rows = numbered(rows, "bucket", F.col("_in"), [F.col("_by")], "_at")
    capacity = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_tokens"), F.lit(1))))
    return rows.select(F.col("_id").alias(id_col), "n_tokens", "bucket", "bucket_tokens", F.floor(F.col("_at") / capacity).alias("batch"), (F.col("_at") % capacity).alias("place"))
