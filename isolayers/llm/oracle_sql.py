"""SQL of the conversation repair and of the Merkle manifest, which is put together from repeated parts."""

from __future__ import annotations

#: Table of the CRC-32 (reflected polynomial 0xEDB88320) by byte.
CRC_TABLE = "crc AS (SELECT list(v ORDER BY i) t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) v FROM range(256) r(i)))"


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, with crc at hand."""
    codes = f"list_transform(range(1, len({text}) + 1), lambda nth: CAST(ord({text}[nth]) AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255) + 1])), 4294967295)"


def _lightest_sql() -> str:
    far = "{'c': CAST(1000000000000000 AS BIGINT), 't': ''}"
    plus = lambda x, c, e: f"{{'c': CAST({x}.c + {c} AS BIGINT), 't': {x}.t || '{e}'}}"
    lowest = lambda *xs: f"list_min([{', '.join(xs)}])"
    # a row's own letter, or another in its place
    given = lambda x, letter: f"CASE WHEN r.gone THEN {far} WHEN r.initial = '{letter}' THEN {plus(x, 'r.late', 'K')} ELSE {plus(x, '3 + r.late', 'R')} END"
    system = f"CASE WHEN NOT r.gone AND r.initial = 's' THEN {plus('n', 'r.late', 'K')} ELSE {far} END"
    return f"""
        start AS (SELECT conv, CAST(0 AS BIGINT) pos, {{'c': CAST(0 AS BIGINT), 't': ''}} n, {far} s, {far} u0, {far} a0 FROM (SELECT DISTINCT conv FROM faulty)),
        f AS (
            SELECT * FROM start UNION ALL
            SELECT e.conv, r.pos, {plus('n', 4, 'D')}, {lowest(plus('s', 4, 'D'), system)},
                   {lowest(plus('u', 4, 'D'), given('n', 'u'), given('s', 'u'), given('a', 'u'))}, {lowest(plus('a', 4, 'D'), given('u', 'a'))}
            FROM (SELECT *, {lowest('a0', plus('u', 3, 'I'))} a FROM (SELECT *, {lowest('u0', plus('n', 3, 'I'), plus('s', 3, 'I'), plus('a0', 3, 'I'))} u FROM f)) e
            JOIN faulty r ON r.conv = e.conv AND r.pos = e.pos + 1),
        ends AS (SELECT conv, {lowest('n', 'a0', plus('u', 3, 'I'))} best
                 FROM (SELECT *, {lowest('u0', plus('n', 3, 'I'), plus('s', 3, 'I'))} u FROM f) SEMI JOIN (SELECT conv, max(pos) pos FROM f GROUP BY conv) USING (conv, pos)),"""


REPAIR = rf"""
    WITH RECURSIVE {CRC_TABLE},
        given AS (SELECT coalesce('k' || conv_id, '') conv, turn, coalesce(role, ' ') role, coalesce(text, ' ') text,
                         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') k FROM conversations),
        fault AS (SELECT conv, turn, role, text, {crc32_sql('k')} % 20 f FROM given, crc),
        damaged AS (SELECT conv, turn, CASE f WHEN 4 THEN 'user' ELSE role END role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END text,
                           unnest(range(CASE f WHEN 3 THEN 2 ELSE 1 END)) copy FROM fault WHERE f <> 0),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) pos, rtrim(text, E' \t\n\v\f\r') bare FROM damaged),
        seen AS (SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) k, lag(role) OVER (PARTITION BY conv ORDER BY pos) before FROM placed),
        faulty AS (SELECT conv, pos, turn, role, text, left(role, 1) initial, bare = '' blank, bare <> '' AND k > 1 duplicate, bare <> '' AND k = 1 AND right(bare, 1) NOT IN ('.', '!', '?') truncated,
                          bare = '' OR k > 1 gone, CASE WHEN right(bare, 1) IN ('.', '!', '?') THEN 0 ELSE 3 END late,
                          before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au') illegal FROM seen),
        {_lightest_sql()}
        letters AS (SELECT conv, best, unnest(range(1, len(best.t) + 1)) i, unnest(string_split(best.t, '')) e FROM ends WHERE best.t <> ''),
        used AS (SELECT *, CASE WHEN e <> 'I' THEN sum(CASE WHEN e <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv ORDER BY i) END pos FROM letters),
        made AS (SELECT used.conv, i, e, role, text FROM used LEFT JOIN faulty USING (conv, pos) WHERE e <> 'D'),
        turns AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY i) - 1 k, max(CASE WHEN e = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv) s FROM made),
        lines AS (SELECT conv, string_agg(CASE WHEN e = 'K' THEN role WHEN (k - s) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, E'\n' ORDER BY i) t FROM turns GROUP BY conv),
        counts AS (SELECT conv, max(turn) - min(turn) + 1 - count(DISTINCT turn) gaps, count(*) FILTER (blank) blank, count(*) FILTER (duplicate) duplicate,
                          count(*) FILTER (truncated) truncated, count(*) FILTER (illegal) illegal FROM faulty GROUP BY conv)
    SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) gaps, CAST(coalesce(blank, 0) AS BIGINT) blank, CAST(coalesce(duplicate, 0) AS BIGINT) duplicate, CAST(coalesce(truncated, 0) AS BIGINT) truncated,
           CAST(coalesce(illegal, 0) AS BIGINT) illegal, CAST(coalesce(best.c, 0) AS BIGINT) cost, coalesce(best.t, '') audit, sha256(coalesce(lines.t, '')) repaired_sha256
    FROM (SELECT DISTINCT conv_id, coalesce('k' || conv_id, '') conv FROM conversations) c LEFT JOIN counts USING (conv) LEFT JOIN ends USING (conv) LEFT JOIN lines USING (conv)"""


def _tree_sql(name: str, levels: int) -> str:
    """Tables {name}{l} (tree, p, h, before, after, n) of the nodes of each level over {name} (tree, p, h); at the top level each tree has one."""
    out, source = [], name
    for level in range(levels + 1):
        last = "NULL AS before, NULL AS after" if level == levels else (
            "coalesce(string_agg(h, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, "
            "coalesce(string_agg(h, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after")  # fmt: skip
        out.append(f"{name}{level} AS (SELECT tree, p, h, count(*) OVER (PARTITION BY tree) n, {last} FROM {source} WINDOW r AS (PARTITION BY tree, p // 16 ORDER BY p))")
        out.append(f"{name}up{level} AS (SELECT tree, p // 16 p, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY p)) ELSE any_value(h) END h FROM {name}{level} GROUP BY tree, p // 16)")
        source = f"{name}up{level}"
    return ",\n".join(out[:-1])


def _fold_sql(of: str, name: str, source: str, levels: int, tree: str, place: str) -> tuple[str, str]:
    """Steps {of}{l} that fold `f` through the levels of a tree and add the siblings to `proof`; and the last one's name."""
    out = []
    for level in range(levels):
        out.append(f"""{of}{level} AS (SELECT s.* REPLACE (CASE WHEN t.n > 1 THEN sha256(t.before || s.f || t.after) ELSE s.f END AS f, CASE WHEN t.n > 1 THEN s.proof || t.before || t.after ELSE s.proof END AS proof)
            FROM {source} s JOIN {name}{level} t ON t.tree = s.{tree} AND t.p = s.{place} // {16**level})""")
        source = f"{of}{level}"
    return ",\n".join(out), source


def _manifest_sql(levels: int = 8, source_levels: int = 4) -> str:
    """Trees of up to 16**levels leaves of a source and 16**source_levels sources."""
    part = lambda x: f"coalesce(strlen({x}) || ':' || {x}, '-')"
    rest = " || ".join(part(f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang", "n_chars"))
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    one, at = _fold_sql("in_source", "a", "started", levels, "tree", "p")
    two, end = _fold_sql("in_root", "b", "between_trees", source_levels, "top", "sp")
    return f"""
    WITH {CRC_TABLE},
        l AS (SELECT doc_id, coalesce('k' || source, '') tree, sha256({rest} || {part('text')}) leaf, sha256({rest} || {part(low)}) other,
                     coalesce({crc32_sql('CAST(doc_id AS VARCHAR)')} % 5 = 0, false) tampered FROM documents, crc),
        leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 p FROM l),
        a AS (SELECT tree, p, leaf h FROM leaves),
        {_tree_sql('a', levels)},
        b AS (SELECT '' tree, row_number() OVER (ORDER BY tree) - 1 p, h, tree AS source FROM a{levels}),
        {_tree_sql('b', source_levels)},
        started AS (SELECT *, CASE WHEN tampered THEN other ELSE leaf END f, '' proof FROM leaves),
        {one},
        between_trees AS (SELECT s.*, '' top, b.p sp, b.h subroot FROM {at} s JOIN b ON b.source = s.tree),
        {two}
    SELECT doc_id, leaf, subroot, r.h root, sha256(proof) proof_sha256, f folded_root, f = r.h verified FROM {end}, b{source_levels} r"""


MANIFEST = _manifest_sql()
