"""Repair of damaged conversations: cheapest edits to turns that alternate, found as lightest derivations (Knuth 1977)."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, gathered, quoted, record_batches, row_tuples, text_key_of, value_of_key
from .numbering import placed

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
#: What has been given so far: nothing, a system turn, a user's, an assistant's; initials may follow each other like this.
STATES = "-sua"
FOLLOWS = {"-": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
GOALS = "-a"
#: Rows of a conversation that one agenda takes; blocks of longer ones are derived apart and then joined.
BLOCK = 512
_BLANK = " \t\n\x0b\x0c\r"
FINE, TRUNCATED, GONE = 0, 1, 2


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", damage: bool = True) -> DataFrame:
    """(conv, turn, role, text) after the damage, if any, that crc32(`conv:turn`) % 20 chooses; a null counts as one space there, as in role and text."""
    space = lambda c: F.coalesce(quoted(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space(conv_col), F.lit(":"), space(turn_col)).cast("binary")) % 20 if damage else F.lit(19)
    rows = rows.select(text_key_of(quoted(conv_col)).alias("conv"), quoted(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where("fault != 0").select("conv", "turn", role.alias("role"), text.alias("text"), copies).drop("col")


def _edges(state: str, initial: str, kind: int) -> Iterator[tuple[int, str, str]]:
    """(cost, edit, state after it) of the edits of one row."""
    yield DELETE, "D", state
    if kind != GONE:
        late = CUT_OFF if kind == TRUNCATED else 0
        for given, after in FOLLOWS[state].items():
            if given == initial:
                yield KEEP + late, "K", after
            if given != "s":
                yield REROLE + late, "R", after


def lightest(rows: list[tuple[str, int]], start: str, goals: str | None = None) -> dict[str, tuple[int, str]]:
    """(cost, audit) of the lightest derivation of each end state from `start` over rows of (initial, kind).

    Items are (rows consumed, state). The agenda pops them by (cost, rows consumed, audit): every edit raises the first or, as a free Keep does,
    the second, so the functions are superior and an item is final when it is popped; audits of equal cost over the same rows are never
    prefixes of one another, so what is appended keeps their order. With goals it ends at the first of these states that is final.
    """
    agenda, final, n, found = [(0, 0, "", start)], set(), len(rows), {}
    while agenda:
        cost, i, audit, state = heapq.heappop(agenda)
        if (i, state) in final:
            continue
        final.add((i, state))
        if i == n:
            found[state] = (cost, audit)
            if goals is not None and state in goals:
                return {state: found[state]}
            if len(found) == len(STATES):
                break
        for given, after in FOLLOWS[state].items():
            if given != "s" and (i, after) not in final:
                heapq.heappush(agenda, (cost + INSERT, i, audit + "I", after))
        if i < n:
            for more, edit, after in _edges(state, *rows[i]):
                if (i + 1, after) not in final:
                    heapq.heappush(agenda, (cost + more, i + 1, audit + edit, after))
    return found


def _illegal(a: str, b: str) -> bool:
    return a + b not in ("su", "ua", "au")


#: Columns of a span of a conversation's rows: its counts, its ends, and for each pair of states the lightest derivation (cost, audit, states between its blocks).
_SPAN = pa.schema(
    [("conv", pa.string()), ("block", pa.int64()), *((n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "distinct", "least", "most", "last_turn", "first_turn")),
     ("head", pa.string()), ("tail", pa.string()), *((n, pa.list_(t)) for n, t in (("between", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("path", pa.string())))]
)
_SPAN_TYPES = (
    "conv string, block long, blank long, duplicate long, truncated long, illegal long, distinct long, least long, most long, last_turn long, first_turn long, "
    "head string, tail string, between array<string>, cost array<long>, audit array<string>, path array<string>"
)


def _groups(rows: Iterator[tuple]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first two fields, (conv, block)."""
    key, held = None, []
    for row in rows:
        if row[:2] != key:
            if held:
                yield key, held
            key, held = row[:2], []
        held.append(row)
    if held:
        yield key, held


def _block_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A span for each block of rows (conv, block, single, turn, initial, fault)."""

    def spans():
        for (conv, block), held in _groups(row_tuples(batches, "conv", "block", "single", "turn", "initial", "fault")):
            turns, initials, faults = ([r[k] for r in held] for k in (3, 4, 5))
            rows = [(i, GONE if f in ("blank", "duplicate") else TRUNCATED if f == "truncated" else FINE) for i, f in zip(initials, faults)]
            if held[0][2]:
                found = {("-", q): v for q, v in lightest(rows, "-", GOALS).items()}
            else:
                found = {(p, q): v for p in ("-" if block == 0 else STATES) for q, v in lightest(rows, p).items()}
            known = [t for t in turns if t is not None]
            yield (
                conv, block, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), sum(map(_illegal, initials, initials[1:])), len(set(known)),
                min(known, default=None), max(known, default=None), turns[-1], turns[0], initials[0], initials[-1],
                [p + q for p, q in found], [c for c, _ in found.values()], [a for _, a in found.values()], [""] * len(found),
            )

    return record_batches(spans(), _SPAN)


def _joined(a: tuple, b: tuple) -> tuple:
    """Two neighbouring spans as one; of each pair of states the lightest of the derivations over all states in the middle."""
    best: dict[str, tuple] = {}
    for between, cost, audit, path in zip(*a[13:17]):
        for then, more, rest, tail in zip(*b[13:17]):
            if between[1] == then[0]:
                item = (cost + more, audit + rest, path + between[1] + tail)
                key = between[0] + then[1]
                if key not in best or item < best[key]:
                    best[key] = item
    both = [x + y for x, y in zip(a[2:6], b[2:6])]
    both[3] += _illegal(a[12], b[11])
    same = a[9] is not None and a[9] == b[10]
    ends = lambda f, x, y: f((v for v in (x, y) if v is not None), default=None)
    return (a[0], a[1], *both, a[6] + b[6] - same, ends(min, a[7], b[7]), ends(max, a[8], b[8]), b[9], a[10], a[11], b[12],
            list(best), *([v[k] for v in best.values()] for k in range(3)))


def _joined_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of the same (conv, upper) as one, by pairs of neighbours, so audits are copied a logarithmic number of times."""

    def spans():
        for (conv, upper), held in _groups(row_tuples(batches, "conv", "upper", *_SPAN.names)):
            spans = [r[2:] for r in held]
            while len(spans) > 1:
                spans = [_joined(*spans[i : i + 2]) if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
            yield (conv, upper, *spans[0][2:])

    return record_batches(spans(), _SPAN)


_RESULT = pa.schema(
    [("conv", pa.string()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())]
)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits and rows in one sorted stream: the conversation (block -1), then each block's edits and its rows. Rows are hashed as they come."""

    def results():
        conv, state, facts, edits, at, given, first = None, hashlib.sha256(), None, "", 0, "-", True

        def turn(role: str, text: str) -> None:
            nonlocal given, first
            state.update(((("" if first else "\n") + role + ":" + text)).encode("utf-8", "surrogatepass"))
            given, first = FOLLOWS[given][role[0]], False

        def inserted() -> None:
            nonlocal at
            while at < len(edits) and edits[at] == "I":
                turn({"u": "user", "a": "assistant"}[min(FOLLOWS[given].keys() - {"s"})], "")
                at += 1

        for key, block, kind, role, text, *row in row_tuples(batches, "conv", "block", "kind", "role", "text", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"):
            if kind == 0:
                inserted()
                if conv is not None:
                    yield (conv, *facts, state.hexdigest())
                conv, state, facts, edits, at, given, first = key, hashlib.sha256(), row, "", 0, "-", True
            elif kind == 1:
                inserted()
                edits, at = row[-1], 0
            else:
                inserted()
                if edits[at] == "K":
                    turn(role, text)
                elif edits[at] == "R":
                    turn({"u": "user", "a": "assistant"}[min(FOLLOWS[given].keys() - {"s"})], text)
                at += 1
        inserted()
        if conv is not None:
            yield (conv, *facts, state.hexdigest())

    return record_batches(results(), _RESULT)


def repaired(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK, damage: bool = True,
) -> DataFrame:
    """One row per conversation of rows: conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are damaged first (see damaged(); with damage=False they are taken as they are, nulls as one space). A conversation's rows follow each
    other by turn, nulls first; rows of one turn by a hash of role and text, so equal ones are neighbours. A null conv_col is a conversation. Repeated
    rows are duplicates, empty texts blank, and a turn whose role has no first letter can't be kept; without rows after damage the counts are 0, the audit is empty and the hash that of the empty
    string. Other columns are left out.

    Rows are placed by range. Blocks of `block` rows are derived apart between all pairs of states and joined 16 at a time, as Knuth's items
    are by further superior functions, so a conversation of any length is spread over tasks; only its audit, one value of the result, and
    its SHA-256, which has to read the repaired text in order, are made in one task, the latter as a stream.
    """
    found = damaged(rows, conv_col, turn_col, role_col, text_col, damage)
    found = found.withColumn("hash", F.xxhash64("role", "text"))
    found = placed(found, "conv", ["turn", "hash"], "pos").withColumn("block", F.floor(F.col("pos") / block))
    bare = F.rtrim("text", F.lit(_BLANK))
    plain = F.when(bare == "", "blank").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")
    short = found.select("conv", "pos", "block", "turn", F.left("role", F.lit(1)).alias("initial"), plain.alias("plain"), F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")).alias("digest"))
    short = cut(short)
    # the first of equal rows, by a partial aggregate; a place is one row's, so no key of the join is hot
    seen = short.groupBy("conv", "digest").agg(F.min("pos").alias("pos")).select("conv", "pos", F.lit(True).alias("is_first"))
    fault = F.when(F.col("plain") == "blank", "blank").when(F.col("is_first").isNull(), "duplicate").otherwise(F.col("plain"))
    short = short.drop("digest").join(seen, ["conv", "pos"], "left").withColumn("fault", fault)
    ends = short.groupBy("conv").agg((F.max("block") == 0).alias("single"))
    # a block's number of rows is bounded, and only its first row has to know whether the conversation has others
    single = short.where(F.col("pos") % block == 0).select("conv", "pos").join(ends, "conv")
    short = short.join(single, ["conv", "pos"], "left")
    blocks = cut(gathered(short.select("conv", "block", "pos", "single", "turn", "initial", "fault"), ["conv", "block"], ("pos",)).mapInArrow(_block_spans, _SPAN_TYPES))

    spans = blocks
    most = blocks.agg(F.max("block")).first()[0] or 0
    while most:
        spans = gathered(spans.withColumn("upper", F.floor(F.col("block") / 16)), ["conv", "upper"], ("block",)).mapInArrow(_joined_spans, _SPAN_TYPES)
        spans, most = cut(spans), most // 16
    items = F.filter(F.arrays_zip("cost", "audit", "between", "path"), lambda x: x["between"].isin(*("-" + g for g in GOALS)))
    whole = spans.withColumn("best", F.array_min(items))
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("distinct"), F.lit(0))
    conversations = rows.select(text_key_of(quoted(conv_col)).alias("conv")).distinct().join(whole, "conv", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    counts = {n: zero(F.col(n)) for n in ("blank", "duplicate", "truncated", "illegal")}
    conversations = cut(conversations.select("conv", gaps.alias("gaps"), *(c.alias(n) for n, c in counts.items()), zero(F.col("best.cost")).alias("cost"), F.coalesce("best.audit", F.lit("")).alias("audit"),
                                             F.col("best.between").alias("between"), F.col("best.path").alias("path")))
    through = F.concat(F.left("between", F.lit(1)), "path", F.right("between", F.lit(1)))
    steps = conversations.where("between IS NOT NULL").select("conv", through.alias("through")).select("conv", "through", F.explode(F.sequence(F.lit(0), F.length("through") - 2)).alias("i"))
    chosen = steps.select("conv", F.col("i").cast("long").alias("block"), F.substring("through", F.col("i") + 1, F.lit(2)).alias("step")).join(blocks.select("conv", "block", "between", "audit"), ["conv", "block"])
    chosen = chosen.select("conv", "block", F.element_at("audit", F.array_position("between", F.col("step")).cast("int")).alias("audit"))

    none = lambda kind: F.lit(None).cast(kind)
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    stream = conversations.select("conv", F.lit(-1).cast("long").alias("block"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("pos"), none("string").alias("role"), none("string").alias("text"), *names, "audit")
    stream = stream.unionByName(chosen.select("conv", "block", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("pos"), none("string").alias("role"), none("string").alias("text"), *(none("long").alias(n) for n in names), "audit"))
    stream = stream.unionByName(found.select("conv", "block", F.lit(2).alias("kind"), "pos", "role", "text", *(none("long").alias(n) for n in names), none("string").alias("audit")))
    out = gathered(stream, ["conv"], ("block", "kind", "pos")).mapInArrow(_repaired, "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    kind = rows.select(quoted(conv_col).alias("c")).schema["c"].dataType
    return out.select(value_of_key("conv", kind).alias(conv_col), *out.columns[1:])
