"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions only.

A source with weight w releases its j-th block (from 0) at slot floor(j / w) and must place it by slot ceil((j + 1) / w);
the released block with the earliest deadline takes the slot. With weights that sum to 1 all deadlines hold,
so at every slot a source is less than one block off its share. Weights are taken as exact whole numbers of 1e-15, without
rounding to a given cycle. The schedule repeats only after the slots in which all shares are whole; if the table needs
fewer, just these are computed. Sources that targets doesn't name have equal weights, so they share the slots of one class in
turn: at most (m - 1) / m of a block for the turn and under 1 / m of one for the class, less than a block again.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, quoted, unpacked
from .numbering import hash_parts, numbered


def scheduled(plan: DataFrame, period: int, slots: int, span: int, number: str) -> DataFrame:
    """(src, slot, i) for the first `slots` slots: i is the source that has the slot, counted from 0.

    plan is one row with src, an array of structs with e, the blocks of a source in `period` slots; their sum is period.
    `span` slots at a time are folded into one array, so that long schedules aren't copied slot by slot. `number` is the
    SQL type that holds slots times period.
    """
    q = f"cast('{period}' as {number})"
    # two steps a slot: choose the released block with the earliest deadline, then book it
    inner = f"""
        aggregate(
            sequence(0, 2 * {span} - 1),
            named_struct('done', acc.done, 'picks', cast(array() as array<int>), 'pick', 0),
            (a, k) -> if(k % 2 = 0,
                named_struct('done', a.done, 'picks', a.picks, 'pick',
                    array_min(transform(src, (s, i) -> if(
                        a.done[i] * {q} div s.e <= part * {span} + k div 2,
                        named_struct('due', ((a.done[i] + 1) * {q} + s.e - 1) div s.e, 'i', i), null))).i),
                named_struct('done', transform(a.done, (d, i) -> cast(d + if(i = a.pick, 1, 0) as {number})),
                    'picks', concat(a.picks, array(a.pick)), 'pick', a.pick)),
            a -> named_struct('done', a.done, 'picks', a.picks))"""
    picks = f"""
        aggregate(
            sequence(0L, {-(-slots // span) - 1}L),
            named_struct('done', transform(src, s -> cast(0 as {number})), 'parts', cast(array() as array<array<int>>)),
            (acc, part) -> transform(array({inner}), r -> named_struct('done', r.done, 'parts', concat(acc.parts, array(r.picks))))[0],
            acc -> flatten(acc.parts))"""
    found = plan.select("src", F.posexplode(F.expr(picks)).alias("slot", "i")).where(F.col("slot") < slots)
    return found.withColumn("slot", F.col("slot").cast("long"))


#: Weights are whole numbers of 1 / UNIT.
UNIT = 10**15
#: Schedules up to this length are broadcast.
SHORT = 65_536


def mixed(
    docs: DataFrame, targets: dict[str, float], id_col: str = "doc_id", source_col: str = "source", block_rows: int = 16,
    cycle: int = 256,
) -> DataFrame:
    """The rows of docs with block, place, slot and first_out: blocks of `block_rows` rows of a source, in the order of slot, then place.

    Sources that targets doesn't name share what it leaves of 1 equally (or weigh as the least of it, if nothing is left).
    Null is a source like any other. Rows of a source are dealt into blocks by a hash of their id, then by id; all rows stay,
    and a source that runs out leaves its slots empty: from the slot first_out on, the first in which a source has no block left, the shares are those
    of the sources that are left. A target must be over 0. `cycle` slots are scheduled at a time;
    the result doesn't depend on it. Rows with equal ids, or none, have their order among themselves by chance. A column of docs called like a
    new one comes back as <name>_input.
    """
    if any(w <= 0 for w in targets.values()):
        raise ValueError("a target weight must be over 0")
    rows = packed(docs, quoted(id_col).alias("_id"), F.coalesce(F.concat(F.lit("="), quoted(source_col).cast("string")), F.lit("")).alias("_source"))
    given = [max(1, round(w * UNIT)) for _, w in sorted(targets.items())]
    others = len(given)
    class_ = F.lit(others)
    for i, name in enumerate(sorted(targets)):
        class_ = F.when(F.col("_source") == f"={name}", F.lit(i)).otherwise(class_)
    names = rows.groupBy("_source").agg(F.count(F.lit(1)).alias("rows")).withColumn("_class", class_)
    # a row per target, and one for all others
    present = {r[0]: (r[1], r[2]) for r in names.groupBy("_class").agg(F.count(F.lit(1)), F.max("rows")).collect()}
    present = present or {others: (1, 1)}
    m = present.get(others, (1, 1))[0]
    left = UNIT - sum(given)
    weights = {c: given[c] if c < others else left if left > 0 else m * min(given) for c in sorted(present)}
    whole = gcd(*weights.values())
    weights = {c: w // whole for c, w in weights.items()}
    period = sum(weights.values())
    blocks = {c: k * (-(-top // block_rows) + 1) for c, (k, top) in present.items()}
    slots = min(period, max(-(-blocks[c] * period // w) for c, w in weights.items()))
    number = "bigint" if (slots + 2) * (period + 1) < 2**62 else "decimal(38,0)"

    src = F.array(*(F.struct(F.lit(c).alias("class"), F.lit(str(w)).cast(number).alias("e")) for c, w in weights.items()))
    plan = docs.sparkSession.range(1).select(src.alias("src"))
    slot = scheduled(plan, period, slots, min(cycle, slots), number).select("slot", F.expr("src[i].class").alias("_class"))
    j = F.row_number().over(Window.partitionBy("_class").orderBy("slot")).cast("long") - 1
    slot = slot.select("_class", j.alias("_j"), F.col("slot").alias("_slot"))
    per = F.lit(None).cast("long")
    for c, w in weights.items():
        per = F.when(F.col("_class") == c, F.lit(w)).otherwise(per)
    if slots <= SHORT:
        slot = F.broadcast(slot)

    turns = numbered(names.select("_source", "_class"), "_class", F.pmod(F.xxhash64("_source"), F.lit(m // 20_000 + 1)), [F.col("_source")], "_turn")
    key = F.col("_id")
    rows = numbered(rows, "_source", hash_parts(rows, key), [F.xxhash64(key), key], "_at", turns)
    rows = rows.withColumn("_block", F.floor(F.col("_at") / block_rows))
    at = F.when(F.col("_class") == others, F.col("_block") * m + F.col("_turn")).otherwise(F.col("_block"))
    rows = rows.withColumn("_b", at).withColumn("_per", per)
    rows = rows.withColumn("_j", F.col("_b") % F.col("_per")).withColumn("_cycle", F.expr("_b div _per"))
    rows = rows.join(slot, ["_class", "_j"]).withColumn("_slot", F.col("_cycle") * period + F.col("_slot"))
    # each source's first block that isn't there, in its class' order, and the slot it would have had
    last = names.join(turns.select("_source", "_turn"), "_source").withColumn("_block", F.ceil(F.col("rows") / block_rows)).withColumn("_b", at).withColumn("_per", per)
    last = last.withColumn("_j", F.col("_b") % F.col("_per")).withColumn("_cycle", F.expr("_b div _per")).join(slot, ["_class", "_j"])
    out = last.agg(F.min(F.col("_cycle") * period + F.col("_slot")).alias("_out"))  # one row
    new = {"block": F.col("_block"), "place": F.col("_at") % block_rows, "slot": F.col("_slot"), "first_out": F.col("_out")}
    return rows.crossJoin(F.broadcast(out)).select(*unpacked(docs.columns, new))
