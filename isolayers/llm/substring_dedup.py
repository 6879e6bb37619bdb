"""Substring dedup: repeated passages found with prefix-partitioned suffix trees.

A suffix here begins at any word of any text and is cut after `window` words. Its group prefix has a variable
length: it runs to the end of the word k-gram with the least hash inside the suffix (its anchor), so equal
suffixes have equal prefixes. Prefixes that end in the same anchor share a group and, as neighbours in the text,
the shipped bytes. A prefix whose group would pass `group_limit` members is extended to the whole suffix.
Suffixes whose anchor occurs once in the corpus can't repeat and are never shipped. Each group's tree is grown
from the root downwards, an edge of several words at a time, and dropping leaves as soon as they stand alone;
the nodes at full depth are the repeats, and their leaves' positions merge into maximal repeats per text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct_texts, quoted, sliced, text_key, unpacked
from .words import Hashes, mixed, normal, sliding, spans

ANCHOR_WORDS = 12
GROUP_LIMIT = 256
#: Passages of hot groups that a task remembers, in bytes; a passage seen again after that is shipped again.
SEEN_BYTES = 64 << 20


def _anchors(text: bytes, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and ends, k-gram hashes, and of each window the least of them (none for short texts)."""
    s, e = spans(text)
    none = np.zeros(0, np.uint64)
    if len(s) < window:
        return s, e, none, none, none
    hashes = Hashes(text)
    grams = hashes.of(s[: len(s) - k + 1], e[k - 1 :])
    return s, e, grams, sliding(np.minimum, grams, window - k + 1), hashes.of(s[: len(s) - window + 1], e[window - 1 :])


def _anchor_counts(window: int, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in sliced(batches):
            keys, values, counts = [], [], []
            for key, body, n in zip(batch["key"], batch["body"], batch["n"]):
                _, _, grams, least, _ = _anchors(normal(body), window, k)
                if len(least):
                    # a k-gram is the anchor of some window if the largest of these windows' least hashes is its own
                    wide = window - k
                    ends = np.zeros(wide, np.uint64)
                    chosen = grams[grams == sliding(np.maximum, np.concatenate((ends, least, ends)), wide + 1)]
                    found, times = np.unique(chosen, return_counts=True)
                    values.append(found.view(np.int64))
                    counts.append(np.ones(len(found), np.int64) if n > 1 else times)
                    keys += [key] * len(found)
            if values:
                yield pd.DataFrame({"anchor": np.concatenate(values), "key": keys, "times": np.concatenate(counts)})

    return run


def _shipped(window: int, k: int, limit: int):
    """Members of the groups, and (without part) repeats that show inside one task already."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[bytes, int] = {}
        held = 0
        for batch in sliced(batches):
            rows: list[tuple] = []
            for key, body, n, anchors, hot in zip(batch["key"], batch["body"], batch["n"], batch["anchors"], batch["hot"]):
                text = normal(body)
                s, e, _, least, whole = _anchors(text, window, k)
                owner = None if n > 1 else key
                order = np.argsort(known := np.asarray(anchors, np.int64).view(np.uint64))
                known, is_hot = known[order], np.asarray(hot, bool)[order]
                at = np.minimum(np.searchsorted(known, least), len(known) - 1)
                ok = known[at] == least
                starts = np.flatnonzero(ok)
                if not len(starts):
                    continue
                hot_at = is_hot[at[starts]]
                cold = starts[~hot_at]
                if len(cold):
                    new = np.flatnonzero(np.concatenate(([True], (np.diff(cold) != 1) | (np.diff(least[cold]) != 0))))
                    for i, j in zip(new, np.concatenate((new[1:], [len(cold)])) - 1):
                        a, b = cold[i], cold[j]
                        rows.append((int(least[a].view(np.int64)), owner, int(a), int(b), text[s[a] : e[b + window - 1]]))
                for a in starts[hot_at].tolist():
                    part = text[s[a] : e[a + window - 1]]
                    group = int(mixed(whole[a : a + 1] ^ least[a : a + 1]).view(np.int64)[0])
                    times = seen.get(part, 0)
                    if not times:
                        held += len(part) + 200
                        if held > SEEN_BYTES:
                            seen.clear()
                            held = len(part) + 200
                        rows.append((group, owner, a, a, part))
                    else:
                        if times == 1:
                            rows.append((group, None, a, a, part))
                        if owner is not None:
                            spread = int.from_bytes(owner[:8], "little", signed=True) ^ a
                            rows.append((spread, owner, a, a + window, None))
                    seen[part] = 2 if times else 1
                if len(rows) >= 20_000:
                    yield _frame(rows)
                    rows = []
            if rows:
                yield _frame(rows)

    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["grp", "owner", "a", "b", "part"])


def deep_leaves(parts: list[bytes], groups: np.ndarray, window: int, edge: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, offset) of each suffix that lies under a node of depth `window` in its group's tree.

    Suffixes start at every word of a part that has `window` words from there on.
    """
    buffer = b" ".join(parts)
    s, e = spans(buffer)
    words = np.array([p.count(b" ") + 1 for p in parts])
    first = np.cumsum(words) - words
    many = words - window + 1
    member = np.repeat(np.arange(len(parts)), many)
    offset = np.arange(len(member)) - np.repeat(np.cumsum(many) - many, many)
    start = first[member] + offset
    hashes = Hashes(buffer)
    node = np.unique(groups, return_inverse=True)[1][member]
    alive = np.arange(len(member))
    for depth in range(0, window, edge):
        last = min(depth + edge, window) - 1
        at = start[alive]
        label = hashes.of(s[at + depth], e[at + last])
        order = np.lexsort((label, node))
        node, label, alive = node[order], label[order], alive[order]
        new = np.concatenate(([True], (np.diff(node) != 0) | (label[1:] != label[:-1])))[: len(node)]
        node = np.cumsum(new) - 1
        branch = np.bincount(node, minlength=1)[node] > 1
        node, alive = node[branch], alive[branch]
        if not len(alive):
            break
    # labels are hashes: a last comparison of the words themselves makes the answer exact
    keep = np.ones(len(alive), bool)
    begins, stops = s[start[alive]].tolist(), e[start[alive] + window - 1].tolist()
    heads = np.flatnonzero(np.concatenate(([True], np.diff(node) != 0)))[: len(node)].tolist()
    for i, j in zip(heads, [*heads[1:], len(alive)]):
        head = buffer[begins[i] : stops[i]]
        if any(buffer[begins[x] : stops[x]] != head for x in range(i + 1, j)):
            inside = [buffer[begins[x] : stops[x]] for x in range(i, j)]
            counts: dict[bytes, int] = {}
            for w in inside:
                counts[w] = counts.get(w, 0) + 1
            keep[i:j] = [counts[w] > 1 for w in inside]
    alive = alive[keep]
    return member[alive], offset[alive]


def _trees(window: int, edge: int):
    """Grows the trees of whole groups; rows come sorted by group, and the last group waits for the next batch."""

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        member, offset = deep_leaves(rows["part"].tolist(), rows["grp"].to_numpy(), window, edge)
        owned = rows["owner"].notna().to_numpy()[member]
        member, offset = member[owned], offset[owned]
        order = np.lexsort((offset, member))
        member, offset = member[order], offset[order]
        new = np.flatnonzero(np.concatenate(([True], (np.diff(member) != 0) | (np.diff(offset) > window)))[: len(member)])
        last = np.concatenate((new[1:], [len(member)]))[: len(new)] - 1
        base = rows["a"].to_numpy()[member[new]]
        return pd.DataFrame({"owner": rows["owner"].to_numpy()[member[new]], "a": base + offset[new], "b": base + offset[last] + window})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            done = batch["part"].isna()
            if done.any():
                yield batch.loc[done, ["owner", "a", "b"]]
                batch = batch[~done]
            if rest is not None:
                batch = pd.concat([rest, batch], ignore_index=True)
            open_ = batch["grp"].to_numpy() == batch["grp"].iloc[-1] if len(batch) else np.zeros(0, bool)
            rest, whole = batch[open_], batch[~open_]
            if len(whole):
                yield found(whole.reset_index(drop=True))
        if rest is not None and len(rest):
            yield found(rest.reset_index(drop=True))

    return run


def _kept(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in sliced(batches):
            words, removed, texts, marks = [], [], [], []
            for body, n, ranges in zip(batch["body"], batch["n"], batch["ranges"]):
                have = body.split()
                drop = np.zeros(len(have) + 1, np.int64)
                if n > 1 and len(have) >= window:
                    drop[0], drop[-1] = 1, -1
                for r in ranges if ranges is not None else ():
                    drop[r["a"]] += 1
                    drop[r["b"]] -= 1
                gone = np.cumsum(drop[:-1]) > 0
                text = b" ".join([w for w, g in zip(have, gone.tolist()) if not g] if gone.any() else have)
                words.append(len(have))
                removed.append(int(gone.sum()))
                texts.append(text if gone.any() else body)
                marks.append(hashlib.sha256(text).hexdigest())
            yield pd.DataFrame({"key": batch["key"], "n_words": words, "n_removed": removed, "kept": texts, "kept_sha256": marks})

    return run


def remove_repeats(
    docs: DataFrame, text_col: str = "text", window: int = 35, with_text: bool = True,
    anchor_words: int = ANCHOR_WORDS, group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """The rows of docs with n_words, n_removed, kept_sha256 (of the kept words, one space between them) and, with_text, the text
    replaced by the kept words where any went; otherwise without the text column.

    A word goes if any `window` consecutive words that cover it also start anywhere else in the input, the same
    text included. All occurrences go. Windows are judged on the input. Null and empty texts have no words (null stays null);
    texts shorter than the window lose none; repeated rows repeat each other. A column of docs called like a new one comes back as <name>_input.
    """
    k = min(anchor_words, window)
    texts = distinct_texts(docs, text_col)
    marks = texts.mapInPandas(_anchor_counts(window, k), "anchor long, key binary, times long")
    shared = marks.groupBy("anchor").agg(F.sum("times").alias("times")).where("times > 1")
    anchors = (
        marks.select("anchor", "key")
        .join(shared, "anchor")
        .groupBy("key")
        .agg(F.collect_list("anchor").alias("anchors"), F.collect_list(F.col("times") > group_limit).alias("hot"))
    )
    shipped = texts.join(anchors, "key").mapInPandas(
        _shipped(window, k, group_limit), "grp long, owner binary, a int, b int, part binary"
    )
    grouped = shipped.repartition("grp").sortWithinPartitions("grp")
    trees = grouped.mapInPandas(_trees(window, max(1, -(-window // 5))), "owner binary, a int, b int")
    ranges = (
        trees.groupBy(F.col("owner").alias("key"))
        .agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    )
    result = texts.join(ranges, "key", "left").mapInPandas(
        _kept(window), "key binary, n_words long, n_removed long, kept binary, kept_sha256 string"
    )
    # the rows themselves travel without their text: it comes back with the result
    body = F.coalesce(quoted(text_col).cast("binary"), F.lit(b""))
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*(quoted(c) for c in others)).alias("row"), text_key(body).alias("key"), quoted(text_col).isNull().alias("none"))
    if not with_text:
        result = result.drop("kept")
    new = {"n_words": F.col("n_words"), "n_removed": F.col("n_removed"), "kept_sha256": F.col("kept_sha256")}
    found = rows.join(result, "key")
    if not with_text:
        return found.select(*unpacked(others, new))
    text = F.when(~F.col("none"), F.decode("kept", "UTF-8"))
    back = unpacked(others, new)
    at = docs.columns.index(text_col)
    return found.select(*back[:at], text.alias(text_col), *back[at:])
