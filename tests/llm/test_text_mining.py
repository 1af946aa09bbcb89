"""HTML extraction, phrase collocations and spelling variants against plain
brute-force versions, and their edge cases."""
import collections
import html
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tabledocs.llm import collocations, html_pages, queries, variants
from tabledocs.session import read_table

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


# -------------------------------------------------------- HTML extraction (11)

BODY = "A sentence of the article that goes on for a while, with a comma and an end. " * 3
CASES = [
    (None, ""), ("", ""), ("<!-- open", ""), ("<div", ""), ("<nav>a <b>menu</b></nav>", ""), ("only text, 2 < 3 &amp; so on", "only text, 2 < 3 & so on"),
    ("<p>a<p>b &lt;i&gt;<br>c&nbsp;&#x27;d&#39;\n\t e", "a\nb <i> c 'd' e"),
    ("<article><h1>T &amp; t</h1><script>if (a<b) '</p>'</script><p>on<b>e</b><!-- x -->!<p>two<style>p{}</style></article><footer>&copy;</footer>", "T & t\none!\ntwo"),
    ("<div class=cookie-bar><p>We use cookies</div><header><h1>Site</h1></header><main><article><header><h1>Title</h1></header><p>Text</p><aside>more</aside>"
     "<form><p>Sign up</p></form><section id=comments><article><p>So good</p></article></section><footer>Tags</footer></article></main>", "Title\nText"),
    (f"<table><tr><td class=sidebar>links</td><td><ul><li>{BODY}<li>second</ul></td></tr></table>", f"{BODY.strip()}\nsecond"),
    ("<div class='page no-sidebar'><div class=menu-bar>m</div><h1>Head</h1><div class='entry-content post-7'>bare <i>text</i><div>inner</div>tail<pre>a\n  b</pre></div><div class=ad-slot>buy</div></div>",
     "Head\nbare text\ninner\ntail\na b"),
    ("<body><article><table><tr><th>k<th>v<tr><td>1<td>2</table><p hidden>no</p><p style='display: none'>no</p><p>yes</article>", "k v\n1 2\nyes"),
    ("<article><p>left <a href='x>y'>link</a> <span class=share>tweet</span>end</p></article>", "left link end"),
    ("<ARTICLE><P>Upper<SCRIPT>x</Script ><P>Case</ARTICLE>", "Upper\nCase"),
    ("<article><div class='newsletter'>mail me</div><p>x &am &amp &quot</p>", "x &am & \""),
]


@pytest.mark.parametrize("page,text", CASES)
def test_extract(page, text):
    assert html_pages.extract(page)[0] == text


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "x", "<p>" * 100_000, '<a href="' * 50_000, "<" * 100_000, "<b" * 100_000, "<!--" * 100_000, "<span>" * 900 + "</i>" * 100_000,
                                  "<li><ul>" * 20_000 + "y", "<article><p>" + "long text " * 500_000])
def test_extract_odd_pages(page):
    text, _ = html_pages.extract(page)
    assert len(text) <= len(page)
    if page.startswith("<article>"):
        assert text == ("long text " * 500_000).strip()


def page_of(article: str, side: str) -> str:
    return f"<body><div class=col-1>{side}</div><div class='col-2 id-{len(article)}'>{article}</div></body>"


def test_hosts_decide(spark):
    """A page whose side text is longer than its article follows its host."""
    usual = [(i, f"http://a.example/{i}", page_of(f"<p>{BODY}{i}</p>" * 3, "<p>side</p>")) for i in range(20)]
    short = (20, "HTTP://A.example/20", page_of("<p>short one</p>", "<p>" + "side " * 8 + "</p>"))
    alone = (21, "http://b.example/21", short[2])
    other = (22, "http://a.example/22", f"<body><section><p>{BODY}</p></section>")
    none = (23, None, short[2])
    df = spark.createDataFrame([*usual, short, alone, other, none], "page_id bigint, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"], r["path"]) for r in html_pages.extract_pages(df).select("row.page_id", "text", "n_chars", "path").collect()}
    assert got[20] == ("short one", 9, "body>div.col-#.id-#") and got[0][0] == "\n".join([BODY + "0"] * 3)
    assert got[21][0] == got[23][0] == ("side " * 8).strip()
    assert got[22][0] == BODY.strip() and len(got) == 24
    paths = {(r["host"], r["path"]): r["votes"] for r in html_pages.host_paths(df).collect()}
    assert paths[("a.example", "body>div.col-#.id-#")] == 20


@pytest.mark.parametrize("hosts", [0, 50_000])
def test_pages_edge(spark, monkeypatch, hosts):
    """Nulls, repeats, clashing names; winners joined or broadcast alike."""
    monkeypatch.setattr(html_pages, "BROADCAST_HOSTS", hosts)
    schema = "page_id bigint, url string, html string, `a.b` int, winners map<string,int>, row string, text int, salt int"
    page = "<article><p>one</p></article>"
    data = [(None, None, None, 1, None, None, 1, 1), (1, "http://x/", page, 1, {"a": 1}, "r", 1, 1), (1, "http://x/", page, 1, {"a": 1}, "r", 1, 1), (2, "no host", page, None, None, None, None, None)]
    got = html_pages.extract_pages(spark.createDataFrame(data, schema)).select("row.page_id", "row.`a.b`", "row.row", "text", "n_chars").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 1, None, "", 0), (1, 1, "r", "one", 3), (1, 1, "r", "one", 3), (2, None, None, "one", 3)], key=str)
    assert html_pages.extract_pages(spark.createDataFrame([], schema)).count() == 0


def test_pages_query(spark):
    """All given pages have one article of plain blocks."""
    want = {}
    for r in read_table(spark, SF01, "pages").collect():
        inner = r["html"][r["html"].index("<article>"):r["html"].index("</article>")]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inner)]
        want[r["page_id"]] = "\n".join(b for b in blocks if b)
    got = {r["page_id"]: r for r in queries.op11_html(spark, SF01).collect()}
    assert {k: r["text"] for k, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


# ----------------------------------------------------- phrase collocations (12)

def brute_phrases(data, min_count, contained=80, top=2000, max_words=4):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in data:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        good = {p: a for p, a in c.items() if len(p) > 1 and a >= min_count}
        kept = []
        for p, a in good.items():
            held = any(len(q) > len(p) and 100 * b >= contained * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in good.items())
            if not held:
                score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def got_phrases(df, **how):
    return sorted(map(tuple, collocations.collocations(df, **how).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def texts(seed=3, n=300):
    r = random.Random(seed)
    vocab = ["Ab", "b", "cC", "d-d", "é", "É", "x y", "日本", "e'", "f "]
    shared = " ".join(r.choice(vocab) for _ in range(700))
    rows = []
    for i in range(n):
        words = [r.choice(vocab) + r.choice(["", "", "", ".", ",", "\n", " \t", "!?"]) for _ in range(r.choice([0, 1, 3, 40, 90]))]
        rows.append((" ".join(words) + (shared if i % 7 == 0 else ""), r.choice(["en", "en", "de", None, ""])))
    return rows + [(None, "en"), ("", "en"), (" \t. .", "fr"), ("same " * 30_000, "es"), (".".join(["a b"] * 9_000), "es")] + rows[:5]


@pytest.mark.parametrize("bits", [1 << 16, 1 << 26])
def test_phrases_brute(spark, bits):
    """The sieve's size changes nothing."""
    data = texts()
    df = spark.createDataFrame(data, "text string, lang string").repartition(5)
    assert got_phrases(df, min_count=30, sieve_bits=bits) == brute_phrases(data, 30)
    assert got_phrases(df, min_count=3, top=7) == brute_phrases(data, 3, top=7)


def test_chunks_parse_once():
    """Each phrase of up to four words is some chunk's own, once."""
    data = [t or "" for t, _ in texts(9, 60)]
    for some in [*[[t] for t in data], data, data[:7]]:
        want, got = collections.Counter(), collections.Counter()
        for text in some:
            for piece in re.split("[.,;:!?\x0a-\x0d]", text.translate(LOWER)):
                w = re.findall("[^\x20\x09]+", piece)
                want.update(tuple(w[i:i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
        for chunk, own in collocations._chunks_of(some, 3):
            tokens = chunk.decode().split(" ")
            starts = [i for i, t in enumerate(tokens) if t not in ("\n", "\r")][:own]
            got.update(tuple(tokens[i:i + k]) for i in starts for k in range(1, 5) if i + k <= len(tokens) and not {"\n", "\r"} & set(tokens[i:i + k]))
        assert got == want


def test_equal_passages_share_chunks():
    r = random.Random(1)
    passage = " ".join(f"w{r.randrange(500)}" for _ in range(2000))
    a, b = (set(collocations._chunks_of([f"{x} {passage}"], 3)) for x in ("one two three", "other words " * 40))
    assert len(a & b) >= len(a) - 2


def test_phrase_scores_are_exact(spark):
    df = spark.sql("select cast(9000000000000000001 as bigint) a, cast(9000000000000000003 as bigint) l, cast(9000000000000000007 as bigint) r")
    got = df.selectExpr("cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + r) s").first()["s"]
    assert got == 2000000 * 9000000000000000001 // (9000000000000000003 + 9000000000000000007)


def test_phrases_edge(spark):
    schema = "`a.b` int, text string, phrase map<string,int>, lang string, n int, f int"
    rows = [(1, "one two " * 40, {"a": 1}, None, 1, 1), (None, None, None, None, None, None), (1, "x y" * 3, None, "und", 1, 1)]
    assert got_phrases(spark.createDataFrame(rows, schema)) == brute_phrases([(r[1], r[3]) for r in rows], 30)
    assert got_phrases(spark.createDataFrame([], schema)) == []
    assert collocations.collocations(spark.createDataFrame(rows, schema), top=None).where("rank is null").count() > 0


# ------------------------------------------------------- spelling variants (13)

def brute_words(data, noise=199, min_chars=6, min_count=5):
    total = collections.Counter()
    for doc, text in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % noise == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= min_chars and n >= min_count}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(words):
    near = collections.defaultdict(list)
    for a, b in itertools.combinations(words, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out)


def got_variants(df, **how):
    return sorted(map(tuple, variants.variant_groups(df, **how).select("word", "form", "root", "n", "n_near", "form_n").collect()))


def test_variants_brute(spark):
    """Short alphabet, so that runs of letters, chains and ties abound."""
    r = random.Random(5)
    stems = ["".join(r.choice("aaàbÿ") for _ in range(r.choice([6, 7, 8]))) for _ in range(60)]
    data = []
    for i in range(400):
        words = []
        for _ in range(40):
            w = stems[min(int(r.expovariate(0.08)), 59)]
            if r.random() < 0.25:
                at = r.randrange(len(w) + 1)
                w = w[:at] + r.choice(["", "a", "b"]) + w[at + r.choice([0, 1]):]
            words.append(w.capitalize() if r.random() < 0.1 else w)
        data.append((i if i % 50 else None, " ".join(words) + r.choice(["", "1x", " Ñandúes ß× "])))
    data += [(1, None), (2, ""), (3, "x"), (3, "aaaaaaa " * 3000), (4, "b" * 100_000), (5, "abcdef " * 700 + "abcdeg " * 100 + "abcdhg " * 10)] + data[:3]
    df = spark.createDataFrame(data, "doc_id bigint, text string").repartition(4)
    words = brute_words(data)
    assert {r["word"]: r["n"] for r in variants.count_words(df).collect()} == words
    want = brute_variants(words)
    assert got_variants(df) == want
    assert any(w[2] not in (w[0], w[1]) for w in want if w[1])  # ways of more than one form


def test_variants_query(spark):
    data = [tuple(r) for r in read_table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = sorted(map(tuple, queries.op13_variants(spark, SF).select("word", "form", "root", "n", "n_near", "form_n").collect()))
    assert got == brute_variants(brute_words(data))


def test_variants_edge(spark):
    schema = "doc_id bigint, text string, `a.b` int, word map<string,int>, n int, key string"
    rows = [(1, "Bottle bottles " * 9, 1, {"a": 1}, 1, "k"), (None, None, None, None, None, None), (1, "bottle " * 99, 1, None, 1, "k")]
    got = got_variants(spark.createDataFrame(rows, schema), noise=None)
    assert got == [("bottle", None, "bottle", 108, 1, None), ("bottles", "bottle", "bottle", 9, 1, 108)]
    assert got_variants(spark.createDataFrame([], schema)) == []


def test_long_ways_to_the_root(spark):
    chain = [(f"w{i:03}", f"w{i + 1:03}") for i in range(100)]
    got = {r["word"]: r["root"] for r in variants.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert set(got.values()) == {"w100"} and len(got) == 100


def test_groups_are_bounded_by_the_alphabet(spark):
    words = spark.range(20_000).select(F.translate(F.lpad("id", 7, "0"), "0123456789", "abcdefghij").alias("word"), F.col("id").alias("n"))
    assert variants.rotations(words).groupBy("key").count().agg(F.max("count")).first()[0] <= 11
