"""Main text, conversation repair and spelling variants against brute force, with awkward rows."""

import collections
import hashlib
import html
import importlib.util
import os
import random
import re
import sys
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytestmark = pytest.mark.skipif(importlib.util.find_spec("quillgrid.llm") is None, reason="no llm subpackage")
sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))

from oracle import DATA, HAVE_DATA  # noqa: E402

from quillgrid.llm import html_text, repair, spelling  # noqa: E402
from quillgrid.llm import queries as Q  # noqa: E402

# --- 11: main text ---


def kept(page):
    texts, verdicts = html_text.lines(page)
    return [t for t, v in zip(texts, verdicts) if v != html_text.DROPPED]


def test_markup_decides():
    page = """<body><div class="site-header">Logo</div><div class=navbar><a href=/>Home</a></div><div id="sideBar">Side</div><p>One &amp; two&nbsp;x<span class="ad">BUY<span>x</span>now</span> three<br>four</p>
      <form><p>Name</p></form><div class="cookie-notice">We use</div><ul><li><a>a</a><li><a>b</a><li><a>c</a></ul><h2>Sub</h2>tail<div class="comments"><article class="comment"><p>nice</p></article></div>
      <script>if (a<b) "<p>x</p>"</script><noscript><p>no</p></noscript><p hidden>h</p><p style="display: none">d</p><div role="navigation">r</div><footer>f</footer>"""
    assert kept(page) == ["One & two x three four", "Sub", "tail"]
    inside = "<header>top</header><main><h1>Out</h1><article><header><h1>T</h1></header><p>a<p>b<aside>s</aside><nav>n</nav><footer>f</footer></article><div class=comments><p>c</p></div></main><p>after"
    assert kept(inside) == ["T", "a", "b"]
    assert kept("<main><h1>T</h1><div>x</div><aside>y</aside></main>z") == ["T", "x"]
    assert kept("<div class=promo>p</div><div class='entry-content'><p>long enough to be most of it</p></div><p>rest") == ["long enough to be most of it"]


def test_broken_markup():
    assert kept("") == [] and kept("<") == ["<"] and kept("<!-- never closed <p>x") == [] and kept("<script>never closed <p>x") == []
    assert kept("a < b <3 &lt;p&gt; &amp &copy; &nope; <p") == ["a < b <3 <p> & © &nope;"]
    assert kept("</p></div><table><tr><td>1<td>2<tr><td>3</table><b>x<p>y</b>z") == ["1", "2", "3", "x", "yz"]
    assert kept('<p title="a > b">x</p><p class="unclosed>y</p>') == ["x", "y"]
    assert kept("<p>" + "<div>" * 20000 + "deep") == ["deep"]
    assert kept("<article>" + "x" * 200_000 + "</article>") == ["x" * 200_000]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=40), st.lists(st.integers(0, 4), max_size=40))
def test_longest_common_subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    found = html_text.shared(a, b)
    rest = iter(b)
    assert len(found) == best[-1][-1] and all(any(a[k] == y for y in rest) for k in found)


def test_differencing(spark):
    """Pages without a declared region: menus shared by neighbours go, articles stay, of copies too; however rows are dealt."""
    rng = random.Random(3)
    rows, article = [], {}
    for i in range(200):
        host = i % 3 if i % 2 else 0  # one host has two thirds of the pages
        own = article[0] if i and i % 5 == 0 else [f"own {i} {k} " + "w" * 30 for k in range(rng.randint(1, 6))]
        article[i] = own
        rows.append((i, f"http://h{host}.org/{'abc'[i % 3]}/{rng.randrange(1000)}?q={i}", f"<div>Menu of {host}</div><div>Hello</div>" + "".join(f"<div>{x}</div>" for x in own) + f"<div>Foot {host}</div>", "clash", "clash"))
    rows += [(1000, None, "<p>a<p>b", "", ""), (1001, "http://alone.org/", None, "", ""), (1002, "http://alone.org/x", "<div>only</div>", "", ""), (1002, "http://alone.org/x", "<div>only</div>", "", ""), (None, "no url", "", None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, text string")
    results = []
    for parts in (1, 7):
        found = html_text.extract(df.repartition(parts))
        assert found.columns == ["page_id", "url", "host", "text"]
        results.append(sorted(((r.page_id is None, r.page_id, r.text) for r in found.collect()), key=repr))
    assert results[0] == results[1] and len(results[0]) == len(rows)
    got = {i: t for _, i, t in results[0]}
    assert {i: got[i] for i in article} == {i: "\n".join(x) for i, x in article.items()}
    assert (got[1000], got[1001], got[1002], got[None]) == ("a\nb", "", "only", "")
    assert html_text.extract(df.limit(0)).count() == 0


def test_alignment_pairs():
    a, b = [1, 2, 3, 4, 2, 5], [2, 9, 4, 2, 7, 5]
    pairs = html_text.aligned(a, b)
    assert len(pairs) == 4 and all(a[i] == b[j] for i, j in pairs)
    assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))


def test_differencing_of_declared_regions(spark):
    """Pages with a declared region are differenced too; a declared article's own lines stay, repeated or not."""
    wide = "w" * 40
    shapes = {"main": "<nav>N</nav><main>{}</main><p>Foot</p>", "named": "<nav>N</nav><div class=content>{}</div>", "article": "<nav>N</nav><article>{}</article><p>Foot</p>"}
    rows = [(f"{kind} {i}", f"http://{kind}.org/{i}", shape.format(f"<p>Print this page</p><p>own {i} {wide}</p><p>Was it helpful?</p>")) for kind, shape in shapes.items() for i in range(6)]
    # an article's line that stands in the open text of its neighbours is no template there either
    rows += [(f"mixed {i}", f"http://mixed.org/{i}", f"<{t}><p>a line</p><p>own {i} {wide}</p></{t}>") for i, t in enumerate(("div", "article", "div"))]
    # large menus that markup drops don't make two pages copies
    rows += [(f"menu {i}", f"http://menu.org/{i}", f"<nav>{'<p>menu</p>' * 50}</nav><main><p>Print</p><p>own {i} {wide}</p></main>") for i in range(3)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id string, url string, html string").repartition(3)).collect()}
    for i in range(6):
        own = f"own {i} {wide}"
        assert got[f"main {i}"] == got[f"named {i}"] == own
        assert got[f"article {i}"] == f"Print this page\n{own}\nWas it helpful?"
    assert [got[f"mixed {i}"] for i in range(3)] == [f"a line\nown {i} {wide}" for i in range(3)]
    assert [got[f"menu {i}"] for i in range(3)] == [f"own {i} {wide}" for i in range(3)]


@pytest.mark.skipif(not HAVE_DATA, reason="no test tables")
def test_main_text_of_the_tables(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = {r.page_id: r for r in Q.op11_main_text(spark, DATA).collect()}
    assert set(got) == set(pages)
    for i, r in pages.items():
        article = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<(b|br)>", " ", x)).split()) for x in re.split("</?p>|</?h1>", article)]
        want = "\n".join(x for x in parts if x)
        assert (got[i].text, got[i].n_chars, got[i].url) == (want, len(want), r.url)


# --- 12: conversation repair ---

NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
KEEP = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def brute_repair(rows):
    """Least (cost, audit) for (initial, must go, unfinished): every least-cost audit is kept as a string, inserts anywhere."""
    layer = {0: [(0, "")]}
    for initial, must, unfinished in rows:
        out = {}
        for state, held in layer.items():
            for cost, audit in held:
                s = state
                for k in range(4):
                    c, a = cost + 2 * k, audit + "I" * k
                    out.setdefault(s, []).append((c + 3, a + "D"))
                    if not must:
                        if initial in KEEP[s]:
                            out.setdefault(KEEP[s][initial], []).append((c + unfinished, a + "K"))
                        out.setdefault(NEXT[s], []).append((c + 2 + unfinished, a + "R"))
                    s = NEXT[s]
        layer = {s: [x for x in sorted(held)[:300] if x[0] == min(held)[0]] for s, held in out.items()}
    ends = []
    for state, held in layer.items():
        for cost, audit in held:
            s = state
            for k in range(4):
                if s in (0, 3):
                    ends.append((cost + 2 * k, audit + "I" * k))
                s = NEXT[s]
    return min(ends)


row_kinds = st.tuples(st.sampled_from("sua-"), st.sampled_from(["", "", "truncated", "blank"]))


@settings(max_examples=300, deadline=None)
@given(st.lists(row_kinds, max_size=10), st.integers(1, 4))
def test_cheapest_edits(rows, size):
    classes = "".join(repair.row_class(*r) for r in rows)
    want = brute_repair([(i, f == "blank", int(f == "truncated")) for i, f in rows])
    cost, macros = repair.solve(classes)
    assert (cost, "".join(macros)) == want
    # in pieces: a table for each, chained, then traced from the last to the first
    c, r, back = [0] + [repair._FAR] * 3, [0] * 4, []
    pieces = [classes[k : k + size] for k in range(0, len(classes), size)]
    for p in pieces:
        c, r, came = repair._chain(c, r, [repair._ends(p, s) for s in range(4)])
        back.append(came)
    total, _, tail, state = repair._tails(c, r)
    audit = "I" * tail
    for p, came in zip(pieces[::-1], back[::-1]):
        audit = "".join(repair.trace(repair.layers(p, came[state])[2], state)) + audit
        state = came[state]
    assert (total, audit) == want


def brute_report(rows):
    of, ids = collections.defaultdict(list), set()
    space = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        ids.add(conv)
        h = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        of[conv] += [(turn, "user" if h == 4 else role, text)] * {0: 0, 3: 2}.get(h, 1)
    out = {}
    for conv in ids:
        rows, seen, faults, state, lines = sorted(of[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])), set(), [], 0, []
        for _, role, text in rows:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end[-1] in ".!?" else "truncated")
            seen.add((role, text))
        cost, audit = brute_repair([(r[1][:1], f in ("blank", "duplicate"), int(f == "truncated")) for r, f in zip(rows, faults)])
        own = iter(rows)
        for e in audit:
            made = "assistant" if state == 2 else "user"
            if e == "I":
                lines.append(made + ":")
            else:
                _, role, text = next(own)
                if e == "D":
                    continue
                lines.append(f"{role if e == 'K' else made}:{text}")
            state = 1 if e == "K" and role[:1] == "s" else NEXT[state]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        known = {t for t, _, _ in rows if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        out[conv] = (conv, max(known) - min(known) + 1 - len(known) if known else 0, *map(faults.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


TURNS = [
    (1, None, None, None), (1, 0, "user", "hi."), (None, 1, "system", "x."), (None, 2, "assistant", "Yo"), (2, 5, "user", ""), (2, 5, "user", ""), (2, 9, "bot", "z!"), (3, 0, "", "text."), (3, 1, "assistant", "A" * 100_000 + "."), (4, 3, "system", "s."),
    *((9, i // 2, ["user", "assistant", "system", "x"][i % 4 if i % 7 else 0], f"m{i % 50}" + ".!?x"[i % 4]) for i in range(200)),
]


@pytest.mark.parametrize("most", [10_000, 2, 0])
def test_repair_report(spark, most):
    df = spark.createDataFrame([(*r, "clash") for r in TURNS], "conv_id long, turn long, role string, text string, audit string")
    got = {r.conv_id: tuple(r) for r in repair.report(repair.damage(df), most_rows=most).collect()}
    assert got == brute_report(TURNS)
    assert repair.report(repair.damage(df.limit(0)), most_rows=most).count() == 0


def test_one_conversation_of_all_rows_is_cut(spark):
    rows = [(7, i, "user" if i % 2 else "assistant", f"t{i}.") for i in range(4000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or else so few rows are one task's
    try:
        sizes = [r.n for r in repair._in_pieces(repair.prepare(df))[1].collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) >= 4 and max(sizes) < 2000 and sum(sizes) == 4000
    a, b = ({tuple(r) for r in repair.report(repair.prepare(df), most_rows=m).collect()} for m in (100, 10_000))
    assert a == b and len(a) == 1


def test_repaired_turns(spark):
    df = repair.prepare(spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string"))
    a, b = (sorted(map(tuple, repair.turns(df, most_rows=m).collect()), key=repr) for m in (10_000, 0))
    assert a == b
    by = collections.defaultdict(str)
    for conv, _, turn, edit, role, _ in sorted(a, key=lambda r: (repr(r[0]), r[1])):
        assert (edit == "I") <= (turn is None)
        by[conv] += role[:1] if edit != "D" else ""
    assert all(re.fullmatch("(s?(ua)+)?", x) for x in by.values())


@pytest.mark.skipif(not HAVE_DATA, reason="no test tables")
def test_repair_of_the_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r) for r in Q.op12_conversation_repair(spark, DATA).collect()}
    assert got == brute_report(rows)


# --- 13: spelling variants ---


def near(a, b):
    a, b = sorted((a, b), key=len)
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute_variants(rows, typos=97, least=3):
    counts = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            w = w if h % typos else w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += len(w) >= 5
    n = {w: k for w, k in counts.items() if k >= least}
    form, size = {}, {}
    for w in n:
        found = [v for v in n if abs(len(v) - len(w)) < 2 and near(w, v)]
        best = min(found, key=lambda v: (-n[v], v), default=None)
        size[w], form[w] = len(found), best if best and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (w, form[w], root, n[w], size[w], n.get(form[w]))
    return out


@pytest.mark.parametrize("most", [4096, 8])
def test_spelling_variants(spark, most):
    """Small blocks split down to single places and lose nothing."""
    rng = random.Random(5)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(5, 9))) for _ in range(60)] + ["x" * 3000, "x" * 3001, "aaaaa", "aaaaaa", "aaaaaaa"]
    rows = [(i, " ".join(rng.choice(base) + rng.choice([" ", "1", ". ", "ÉÀ ", "_"]) for _ in range(80))) for i in range(60)]
    rows += [(None, "straße STRASSE Straße straße×"), (3, None), (3, ""), (3, "aaaaa " * 40), (4, "éé 日本語 " * 5)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, word string, n int")
    got = {r.word: tuple(r) for r in spelling.variants(spelling.words(df, typos=97), most=most).collect()}
    assert got == brute_variants(rows)
    assert spelling.variants(spelling.words(df.limit(0), typos=97), most=most).count() == 0


def test_chains_of_forms(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(20)] + [("w20", None), ("v", "w20"), ("lone", None)]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert got == {w: "lone" if w == "lone" else "w20" for w, _ in forms}
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([], "word string, n long"), ratio=1)


@pytest.mark.skipif(not HAVE_DATA, reason="no test tables")
def test_spelling_of_the_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.word: tuple(r) for r in Q.op13_spelling_variants(spark, DATA).collect()}
    assert got == brute_variants(rows)
