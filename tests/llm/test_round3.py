"""Conversation repair, Merkle manifest and HTML extraction against plain versions of themselves."""

import hashlib
import html
import itertools
import random
import re
import zlib
from html.parser import HTMLParser

import duckdb
import pytest

from isolayers.llm import conversation_repair, html_text, merkle_manifest, queries

DIR = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, audit string"
DOCS = "doc_id long, text string, source string, lang string, n_chars long, leaf string"


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_merkle_manifest"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.sql(queries.ORACLE[name]).df()
    got = queries.QUERIES[name](spark, DIR).toPandas()
    columns = list(want.columns)
    assert sorted(got.columns) == sorted(columns) and len(got) == len(want)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert (got == want).all().all()


def brute_repair(rows):
    """Cheapest edits of (role, text) rows by trying all, up to three insertions at each place."""
    kinds, seen = [], set()
    for role, text in rows:
        bare = text.rstrip(" \t\n\v\f\r")
        kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None
    choices = []
    for (role, _), kind in zip(rows, kinds):
        late = 3 if kind == "truncated" else 0
        each = [(4, "D", None)]
        if kind in ("", "truncated"):
            each += [(late, "K", role)] + [(3 + late, "R", r) for r in ("user", "assistant")]
        choices.append([e for e in each])
    added = [[(3 * n, "I" * n, roles) for roles in itertools.product(("user", "assistant"), repeat=n)] for n in range(3)]
    added = [x for group in added for x in group]
    for picks in itertools.product(*itertools.chain.from_iterable(([added, c] for c in choices)), added):
        cost, audit, lines = 0, "", []
        for k, (c, edit, what) in enumerate(picks):
            cost, audit = cost + c, audit + edit
            if k % 2 == 0:
                lines += [(r, "") for r in what]
            elif what is not None:
                lines.append((what, rows[k // 2][1]))
        if best is not None and (cost, audit) >= best[:2]:
            continue
        if re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] for r, _ in lines)):
            best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in lines))
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:])]
    return (*(kinds.count(k) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest())


def some_conversations(n=60, seed=3):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", " ", "ux"], ["Yes.", "No!", "What?", "cut off", " ", "", "a.  ", "é"]
    return [[(rng.choice(roles), rng.choice(texts)) for _ in range(rng.randrange(1, 4))] for _ in range(n)]


def found_for(spark, conversations, **options):
    rows = [(i, t, role, text, "clash") for i, c in enumerate(conversations) for t, (role, text) in enumerate(c)]
    return {r.conv_id: tuple(r)[2:] for r in conversation_repair.repaired(spark.createDataFrame(rows, TURNS), damage=False, **options).collect()}


def test_repair_against_all_edits(spark):
    conversations = some_conversations()
    got = found_for(spark, conversations)
    assert got == {i: brute_repair(c) for i, c in enumerate(conversations)}


def test_long_conversations_in_blocks(spark):
    """Blocks of any length give the same derivation as one agenda over the whole."""
    rng = random.Random(8)
    conversations = [[(rng.choice(["user", "assistant", "system"]), rng.choice([f"t{k}.", f"t{k}", "", "x."])) for k in range(n)] for n in (1, 2, 3, 40, 41, 333)]
    whole = found_for(spark, conversations, block=1000)
    assert whole == found_for(spark, conversations, block=1) == found_for(spark, conversations, block=3)


def test_damage_nulls_and_lost_conversations(spark):
    rows = [(i, t, role, "It is so. Or not?", "x") for i in range(40) for t, role in enumerate(["system", "user", "assistant", "user", "assistant"])]
    rows += [(None, None, None, None, "x"), (None, 3, "user", "Same.", "x"), (None, 3, "user", "Same.", "x"), (77, None, "user", None, "x")]
    df = spark.createDataFrame(rows, TURNS)
    got = {r.conv_id: r for r in conversation_repair.repaired(df).collect()}
    assert set(got) == {*range(40), None, 77}
    for i in range(40):
        after = []
        for t, role in enumerate(["system", "user", "assistant", "user", "assistant"]):
            fault, text = zlib.crc32(f"{i}:{t}".encode()) % 20, "It is so. Or not?"
            role = "user" if fault == 4 else role
            text = "" if fault == 1 else "It is so Or not" if fault == 2 else text
            after += [(t, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
        turns = [t for t, _, _ in after]
        assert got[i].gaps == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        assert tuple(got[i])[2:6] == brute_repair([(r, t) for _, r, t in after[:1]])[:4] if len(after) == 1 else True
        assert got[i].cost >= 0 and len(got[i].audit.replace("I", "")) == len(after)
    gone = [i for i in range(3000) if all(zlib.crc32(f"{i}:{t}".encode()) % 20 == 0 for t in (0,))][0]
    r = conversation_repair.repaired(spark.createDataFrame([(gone, 0, "user", "a.", "")], TURNS)).collect()
    assert [tuple(x) for x in r] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert conversation_repair.repaired(df.limit(0)).count() == 0


def brute_manifest(docs):
    h = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    part = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"

    def leaf(d, text):
        return h(*(part(x) for x in (d[0], d[2], d[3], d[4])), part(text))

    def fold(nodes):
        """(root, siblings of each node as [(left, right)] by level)"""
        sides, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
            for k, p in enumerate(at):
                run = runs[p // 16]
                sides[k].append(("".join(run[: p % 16]), "".join(run[p % 16 + 1 :])))
                at[k] = p // 16
            nodes = [h(*run) for run in runs]
        return nodes[0], sides

    sources = sorted({d[2] for d in docs}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted((d for d in docs if d[2] == s), key=lambda d: (d[0] is not None, d[0] or 0, leaf(d, d[1])))
        trees[s] = (own, *fold([leaf(d, d[1]) for d in own]))
    root, above = fold([trees[s][1] for s in sources])
    out = []
    for s, up in zip(sources, above):
        own, subroot, sides = trees[s]
        for d, mine in zip(own, sides):
            text = d[1]
            if text is not None and d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            digest = leaf(d, text)
            for left, right in mine + up:
                digest = h(left, digest, right)
            out.append((d[0], leaf(d, d[1]), subroot, root, h(*(a + b for a, b in mine + up)), digest, digest == root))
    return out


@pytest.mark.parametrize("n", [1, 2, 16, 17, 300, 4200])
def test_manifest_against_plain_trees(spark, n):
    rng = random.Random(n)
    docs = [(rng.choice([i, i, i, None]) if n < 1000 else i, rng.choice([None, "", "Ab é", f"Text {i}", "ABC"]), rng.choice(["a", "a", "b", None, "", "é"]) if n < 1000 else "a",
             rng.choice(["en", None]), rng.choice([None, i])) for i in range(n)]
    docs += docs[:3]  # repeated rows
    df = spark.createDataFrame([(*d, "clash") for d in docs], DOCS).repartition(3)
    key = lambda r: tuple((x is not None, x) for x in r)
    got = sorted((tuple(r) for r in merkle_manifest.manifest(df).collect()), key=key)
    assert got == sorted(brute_manifest(docs), key=key)


def test_manifest_of_nothing_and_of_many_sources(spark):
    assert merkle_manifest.manifest(spark.createDataFrame([], DOCS)).count() == 0
    docs = [(i, "T", f"s{i}", "en", 1) for i in range(300)]
    got = sorted(tuple(r) for r in merkle_manifest.manifest(spark.createDataFrame([(*d, "") for d in docs], DOCS)).collect())
    assert got == sorted(brute_manifest(docs))


class Plain(HTMLParser):
    """Text of the blocks inside of article, by the parser of the standard library."""

    def __init__(self):
        super().__init__()
        self.depth, self.blocks, self.now = 0, [], []

    def end(self):
        words = " ".join("".join(self.now).split())
        self.blocks += [words] * (bool(words) and self.depth > 0)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h1", "article", "footer"):
            self.end()
        self.depth += tag == "article"
        self.now += [" "] * (tag == "br")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article", "footer"):
            self.end()
        self.depth -= tag == "article"

    def handle_data(self, data):
        self.now.append(data)


def test_pages_against_another_parser(spark):
    got = {r.page_id: r for r in queries.op13_html_extraction(spark, DIR).collect()}
    pages = spark.read.parquet(f"{DIR}/pages.parquet").collect()
    assert len(got) == len(pages)
    for page in pages:
        plain = Plain()
        plain.feed(page.html)
        plain.end()
        assert got[page.page_id].text == "\n\n".join(plain.blocks) and got[page.page_id].n_chars == len(got[page.page_id].text), page.page_id


BODY = ["A heading", "The first paragraph says what the article is about, in a sentence or two. It has enough words to be text.", "So.",
        "A second paragraph follows &amp; is about as long as the first one, so that both stand out from menus and the like.", "The end."]
AROUND = {
    "nav": "<nav><ul><li><a href='/'>Home</a><li><a href='/x'>Topics of all kinds</a></ul></nav>", "header": "<header>The daily page, news since 1900</header>",
    "footer": "<footer>Copyright by the publisher, all rights reserved</footer>", "side": "<div class='left-sidebar'><p>Most read today, a list of what others have read</div>",
    "cookie": "<div id='cookie-notice'>We use cookies to make this page better for you. Accept?</div>", "ad": "<div class=\"ad\">Buy our very good things now, they are cheap this week only.</div>",
    "form": "<form><label>Your address</label><input name=q><button>Send</button></form>", "script": "<script>var x = '<p>not text, not text, not text, not text, not text</p>';</script>",
    "comments": "<section class='comments'><p>I liked this very much, and will read it again tomorrow with my friends.</p></section>", "hidden": "<p style='display: none'>Unseen words of no use to anyone</p>",
}


@pytest.mark.parametrize("holder", ["<article>{}</article>", "<main>{}</main>", "<div class='content'>{}</div>", "<div class='ad'><article>{}</article></div>", "<div><section>{}</section></div>"])
def test_what_is_around_an_article_goes(holder):
    rng = random.Random(4)
    want = "\n\n".join(html.unescape(b) for b in BODY)
    for _ in range(20):
        before, after = rng.sample(list(AROUND.values()), 3), rng.sample(list(AROUND.values()), 3)
        middle = list(BODY)
        blocks = [f"<h1>{middle[0]}</h1>"] + [f"<p>{b}" for b in middle[1:]]
        blocks.insert(2, AROUND[rng.choice(["ad", "side", "script", "form"])])
        page = "<html><body class='with-sidebar'>" + "".join(before) + holder.format("".join(blocks)) + "".join(after)
        assert html_text.main_text(page) == want, page


def test_odd_pages(spark):
    long = "<p>" + "word " * 400_000 + "</p>"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<article>Tiny&nbsp;one.", "x"), (3, "u", "<nav>a b c</nav>", "x"), (4, "u", "plain text, no markup at all", "x"), (5, "u", long, "x"), (5, "u", long, "x")]
    got = html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 9), (1, 0), (2, 0), (3, 0), (4, 28), (5, 1_999_999), (5, 1_999_999)]
    assert got[0].text == "" and html_text.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("piece", ["<", " ", "<!--", "<a ", "<a b=\"", "<p>x", "<div>x", "&amp", "</div>", "<script>", "<div class='x y z'>", "<![CDATA[", "</"])
def test_long_odd_pages_take_linear_time(piece):
    html_text.main_text(piece * (2_000_000 // len(piece)))
    html_text.main_text("<div>" * 100_000 + "</nav>" * 100_000 + "<article>x" * 50_000)
