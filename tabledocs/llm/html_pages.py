"""HTML extraction by consensus host paths: each page's containers are scored,
every page votes for the generalised tag-class path of its best one, Spark
counts the votes per host, and the pages are extracted again with their host's
winning paths.

How it runs
  1. One pass over the pages gives a vote (host, path) for each page that has
     text; votes are counted per host and path (partial counts first, so a host
     with a third of all pages costs one row a task).
  2. A host's winning paths are those with at least ``1 / MAX_PATHS`` of its
     votes, so at most ``MAX_PATHS`` a host.
  3. The second pass reads the pages with their host's winners beside them (a
     broadcast up to ``BROADCAST_HOSTS`` hosts, else a join salted by page)
     and extracts the text of all containers on the first winning path that
     holds a fair share of the page's text; else of the page's own best one.

A path is the chain of tags and classes from the body, with digits generalised
(``div.post-17`` is ``div.post-#``). Left out are, by tag, role, class or id:
menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
reader comments and hidden elements. A header within an article that holds a
heading belongs to the article.

Text: character references are decoded, white space inside a block (a ``br``
too) is one space, blocks are trimmed and joined by one newline, table cells by
a space. Tags that are left open close as HTML's rules imply; elements below a
depth of 512 count as text of the one above.

Defined results
  null or empty html, or no text: text '', n_chars 0. null url or one without
    a host: the page's own best container. Plain text without tags: itself.
  null ids, repeated rows: each row is judged alike. Empty table: empty result.
  Input columns of any name and type pass in ``row``.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabledocs.llm.common import prepare, quoted
from tabledocs.llm.url_filter import host_and_path
from tabledocs.session import materialize

MAX_PATHS = 10
#: Hosts whose winners may be broadcast: at most about 300 bytes each.
BROADCAST_HOSTS = 50_000
SALTS = 32
MAX_DEPTH = 512
#: A winning path is used if it holds this share of the text of the page's own choice.
FAIR_SHARE = 0.2

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
GONE = frozenset("head nav aside footer script style noscript iframe object svg canvas video audio template dialog menu "
                 "button select textarea input label fieldset legend datalist option title xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul search legend".split())
CONTAINER = frozenset("article body center div form header main section table tbody td tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("meta link title script style base noscript template".split())
#: For a start tag: the open tags it closes, and the tags that shield them.
CLOSES = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
          "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
          **{t: (("thead", "tbody", "tfoot"), ("table",)) for t in ("thead", "tbody", "tfoot")},
          "option": (("option",), ("select", "datalist")), "a": (("a",), BLOCK)}
#: What an end tag can't close through: beyond table cells, and for inline ones beyond their block.
SHIELDS = frozenset("table td th caption object template button body".split())
IN_TABLE = frozenset("thead tbody tfoot tr td th caption".split())

_INLINE_SHIELDS = BLOCK | SHIELDS

#: Words of class, id or role that mark what is left out, whatever it holds ...
ALWAYS = frozenset("ad ads adsense adslot adbox adunit disqus respond reply replies nav sidenav topnav contentinfo complementary consent gdpr "
                   "subscribe signup share sharing social pagination pager alertdialog".split())
#: ... or parts of such words ...
ALWAYS_PART = re.compile("comment(?!ary)|advert|sponsor|navbar|navigation|breadcrumb|footer|cookie|newsletter")
#: ... those of headers ...
HEADERS = frozenset("header masthead banner topbar siteheader pageheader".split())
#: ... and those that do unless the element holds the page's first heading or its main part.
MAYBE = frozenset("sidebar aside rail widget widgets menu menubar submenu mainmenu notice notices alert alerts notification notifications announcement infobar paywall privacy promo promos "
                  "promotion popup modal overlay lightbox related recommended recommendations trending popular login search searchbox toolbar copyright form dialog".split())
HINTS = frozenset("article content entry post story main text body articlebody blogpost".split())
NEGATIONS = frozenset("has no with without is not".split())

_TOKEN = re.compile(r"<!--(?:-?>|.*?--!?>|.*\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>|<[!?/][^>]*+>", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"[0-9]+")


def _facts(tag: str, attrs: str) -> tuple[str, int, float]:
    """(path step, how it is left out, weight). Left out: 0 no, 1 always, 2 (forms)
    unless it holds the page's h1 or article, 3 (headers) unless it is an
    article's own with a heading, or holds the article, 4 unless it holds the
    page's h1 or main part."""
    given = {}
    for name, value in _ATTR.findall(attrs):
        given.setdefault(name.lower(), entities.unescape(value.strip("\"'")))
    classes = sorted(set(_DIGITS.sub("#", given.get("class", "")).split()))
    step = ".".join([tag, *classes])
    marks = set()
    for name in ("class", "id", "role"):
        words = [w.lower() for w in _WORDS.findall(given.get(name, ""))]
        words += [a + b for a, b in zip(words, words[1:]) if a not in NEGATIONS]  # side-bar
        marks.update(w for i, w in enumerate(words) if i == 0 or words[i - 1] not in NEGATIONS)
    role = given.get("role", "").lower()
    out = 0
    if tag in GONE or "hidden" in given or given.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", given.get("style", ""), re.I):
        out = 1
    elif tag in ("main", "body") or role == "main":
        out = 0
    elif marks & ALWAYS or any(ALWAYS_PART.search(w) for w in marks):
        out = 1
    elif tag == "header" or tag not in HEADINGS and tag != "article" and marks & HEADERS and not marks & HINTS:
        out = 3
    elif tag == "form":
        out = 2
    elif tag not in HEADINGS and tag != "article" and (marks & MAYBE or marks & HEADERS):
        out = 4
    weight = 4.0 if tag == "article" or "articlebody" in given.get("itemprop", "").lower() or role == "article" else \
        3.0 if tag == "main" or role == "main" else 2.0 if marks & HINTS else 1.0
    return step, out, weight


_known_facts = lru_cache(8192)(_facts)


class Page:
    """The elements of one page (0 is the body; parents come before their
    children) and its text in pieces (element, text), None for a block's edge."""

    def __init__(self, html: str):
        self.tag, self.parent, self.step, self.out, self.weight, self.path = ["body"], [-1], ["body"], [0], [1.0], [0]
        self.pieces: list[tuple[int, str | None]] = []
        self._paths: dict[tuple[int, str], int] = {(-1, "body"): 0}
        self._path_steps: list[tuple[int, str]] = [(-1, "body")]
        self._read(html)
        self._judge()

    def _read(self, html: str) -> None:
        stack, count, pieces = [0], defaultdict(int), self.pieces
        tags, pos, end = self.tag, 0, len(html)
        last = html.rfind(">")

        def pop_to(k: int) -> None:
            for e in stack[k:]:
                count[tags[e]] -= 1
                if tags[e] in BLOCK:
                    pieces.append((e, None))
                elif tags[e] in ("td", "th"):
                    pieces.append((e, " "))
            del stack[k:]

        def close(names, shields) -> bool:
            if any(count[n] for n in names):
                for k in range(len(stack) - 1, 0, -1):
                    t = tags[stack[k]]
                    if t in names:
                        pop_to(k)
                        return True
                    if t in shields:
                        break
            return False

        while pos < end:
            at = html.find("<", pos)
            if at < 0:
                at = end
            elif at > last and at + 1 < end and (html[at + 1].isalpha() or html[at + 1] in "/!?"):
                end = at if not html.startswith("<!--", at) else end  # a tag that never ends
            if at > pos:
                text = html[pos:at]
                if count["head"] and not text.isspace() and tags[stack[-1]] == "head":
                    close(("head",), ())
                pieces.append((stack[-1], text))
            if at >= end:
                break
            m = _TOKEN.match(html, at)
            if m is None:  # a lone sign
                pieces.append((stack[-1], "<"))
                pos = at + 1
                continue
            pos = m.end()
            name = m.group(2)
            if name is None:
                continue
            tag = name.lower()
            if m.group(1):
                if tag == "br":
                    pieces.append((stack[-1], " "))
                elif tag in HEADINGS:
                    close(HEADINGS, SHIELDS)
                elif tag not in ("body", "html"):
                    close((tag,), ("table",) if tag in IN_TABLE else () if tag == "table" else SHIELDS if tag in BLOCK else _INLINE_SHIELDS)
                continue
            if tag in ("html", "body"):
                if tag == "body":
                    close(("head",), ())
                continue
            if tag not in IN_HEAD and count["head"]:
                close(("head",), ())
            if tag in BLOCK:
                close(("p",), SHIELDS)
            if tag in HEADINGS and tags[stack[-1]] in HEADINGS:
                pop_to(len(stack) - 1)
            if tag in CLOSES:
                close(*CLOSES[tag])
            if tag in VOID:
                pieces.append((stack[-1], None if tag == "hr" else " " if tag == "br" else ""))
                continue
            if tag in RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, pos)
                if not stop:
                    break
                pos = html.find(">", stop.end()) + 1 or end
                continue
            if len(stack) >= MAX_DEPTH:
                if tag in BLOCK:
                    pieces.append((stack[-1], None))
                continue
            attrs = m.group(3)
            step, out, weight = _known_facts(tag, attrs if tag != "a" else "") if len(attrs) < 200 or tag == "a" else _facts(tag, attrs)
            e, above = len(tags), stack[-1]
            tags.append(tag)
            self.parent.append(above)
            self.step.append(step)
            self.out.append(out)
            self.weight.append(weight)
            if tag in CONTAINER:
                key = (self.path[above], step)
                if key not in self._paths:
                    self._paths[key] = len(self._path_steps)
                    self._path_steps.append(key)
                self.path.append(self._paths[key])
            else:
                self.path.append(self.path[above])
            stack.append(e)
            count[tag] += 1
            if tag in BLOCK:
                pieces.append((e, None))

    def _judge(self) -> None:
        """What is left out, and each element's text outside and inside links."""
        n, tag, parent, out = len(self.tag), self.tag, self.parent, self.out
        # a heading, an h1, an article or main, a main below
        heading, title, core, main = ([False] * n for _ in range(4))
        for e in range(n - 1, 0, -1):
            if out[e] != 1:
                p = parent[e]
                heading[p] |= heading[e] or tag[e] in HEADINGS
                title[p] |= title[e] or tag[e] == "h1"
                core[p] |= core[e] or tag[e] in ("article", "main")
                main[p] |= main[e] or tag[e] == "main"
        article, link = [False] * n, [False] * n
        self.gone = gone = [False] * n
        for e in range(1, n):
            p = parent[e]
            article[e], link[e] = article[p] or tag[e] in ("article", "main"), link[p] or tag[e] == "a"
            kept = (True, False, core[e] or title[e], core[e] or heading[e] and article[p], title[e] or main[e])[out[e]]
            gone[e] = gone[p] or not kept
        self.good, self.linked, self.h1 = [0] * n, [0] * n, [0] * n
        for e, text in self.pieces:
            if text and not gone[e]:
                size = len(text.strip())
                if link[e]:
                    self.linked[e] += size
                else:
                    self.good[e] += size
                if tag[e] == "h1":
                    self.h1[e] += size
        for e in range(n - 1, 0, -1):
            for x in (self.good, self.linked, self.h1):
                x[parent[e]] += x[e]

    def path_text(self, p: int) -> str:
        steps = []
        while p >= 0:
            p, step = self._path_steps[p]
            steps.append(step)
        return ">".join(reversed(steps))

    def path_keys(self) -> list[int]:
        """A 64-bit key of each path, from the keys above it."""
        keys: list[int] = []
        for p, step in self._path_steps:
            keys.append(xxhash.xxh64_intdigest(step.encode("utf-8", "replace"), seed=keys[p] if p >= 0 else 0))
        return keys

    def best(self) -> int | None:
        """The container that scores highest; None without text."""
        good, n = self.good, len(self.tag)
        if not good[0] + self.linked[0]:
            return None
        # without any mark: the lowest element that holds most of the text
        low, inner = 0, [[] for _ in range(n)]
        for e in range(1, n):
            if self.tag[e] in CONTAINER and not self.gone[e]:
                inner[self.parent[e]].append(e)
        while True:
            down = max(inner[low], key=lambda e: (good[e], -e), default=None)
            if down is None or good[down] == 0 or good[down] < 0.8 * good[low]:
                break
            low = down
        choice, score = low, float(good[low])
        for e in range(1, n):
            if self.weight[e] > 1 and not self.gone[e] and self.tag[e] in CONTAINER:
                s = self.weight[e] * (good[e] - 0.5 * self.linked[e])
                if s > score:
                    choice, score = e, s
        # the heading may stand just outside
        if not self.h1[choice]:
            up = self.parent[choice]
            while up > 0 and not self.h1[up] and self._spare(up, choice):
                up = self.parent[up]
            if up >= 0 and self.h1[up] and self._spare(up, choice):
                choice = up
        while choice > 0 and self.tag[choice] not in CONTAINER:
            choice = self.parent[choice]
        return choice

    def _spare(self, up: int, choice: int) -> bool:
        """Little stands in ``up`` outside of ``choice`` but a heading."""
        more = self.good[up] + self.linked[up] - self.good[choice] - self.linked[choice] - self.h1[up]
        return more <= 0.1 * self.good[choice] + 60

    def text(self, chosen: set[int]) -> str:
        """The text of the chosen elements, block by block in page order."""
        inside = [False] * len(self.tag)
        for e in range(len(self.tag)):
            inside[e] = (e in chosen or (e > 0 and inside[self.parent[e]])) and not self.gone[e]
        blocks: list[str] = []
        run: list[str] = []

        def flush() -> None:
            block = " ".join("".join(run).split())
            if block:
                blocks.append(block)
            run.clear()
        for e, text in self.pieces:
            if text is None:
                flush()
            elif inside[e]:
                run.append(entities.unescape(text) if "&" in text else text)
        flush()
        return "\n".join(blocks)


def extract(html: str | None, winners: list[int] | None = None) -> tuple[str, str | None]:
    """(text, path used) of one page, given its host's winning path keys in order."""
    if not html:
        return "", None
    page = Page(html)
    own = page.best()
    if own is None:
        return "", None
    if winners:
        keys = page.path_keys()
        at = {k: p for p, k in enumerate(keys)}
        for w in winners:
            p = at.get(w & (1 << 64) - 1)
            if p is None:
                continue
            chosen = {e for e in range(len(page.tag)) if page.path[e] == p and page.tag[e] in CONTAINER and not page.gone[e]}
            if chosen and sum(page.good[e] for e in chosen) >= FAIR_SHARE * page.good[own]:
                return page.text(chosen), page.path_text(p)
    return page.text({own}), page.path_text(page.path[own])


def _votes(batches):
    for batch in batches:
        hosts, keys, paths = [], [], []
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            if not html:
                continue
            page = Page(html)
            e = page.best()
            if e is not None:
                hosts.append(host)
                keys.append(page.path_keys()[page.path[e]])
                paths.append(page.path_text(page.path[e]))
        signed = [k - (1 << 64) if k >> 63 else k for k in keys]
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(signed, pa.int64()), pa.array(paths, pa.string())], names=["host", "key", "path"])


def _extract(batches):
    for batch in batches:
        text, path = [], []
        for html, winners in zip(batch.column("html").to_pylist(), batch.column("winners").to_pylist()):
            t, p = extract(html, winners)
            text.append(t)
            path.append(p)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), pa.array(path, pa.string())],
                                         names=["row", "text", "n_chars", "path"])


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Each host's paths with their votes: host, key, path, votes, host_votes,
    of the paths with at least 1/MAX_PATHS of the host's votes."""
    prepare(pages.sparkSession)
    host = host_and_path(F.col(quoted(url_col)))[0]
    seen = pages.select(host.alias("host"), F.col(quoted(html_col)).alias("html")).where(F.col("host") != "")
    counted = materialize(seen.mapInArrow(_votes, "host string, key bigint, path string")
                          .groupBy("host", "key").agg(F.count("*").alias("votes"), F.min("path").alias("path")), "host-paths")
    return (counted.join(counted.groupBy("host").agg(F.sum("votes").alias("host_votes")), "host")
            .where(F.col("votes") * MAX_PATHS >= F.col("host_votes")))


def extract_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The rows of ``pages``: ``row`` (a struct of the input's columns but the
    html), ``text``, ``n_chars`` and ``path`` (the container path used)."""
    prepare(pages.sparkSession)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), "key")))
    winners = materialize(host_paths(pages, url_col, html_col).groupBy("host").agg(ranked.getField("key").alias("winners")), "host-winners")
    base = pages.select(host_and_path(F.col(quoted(url_col)))[0].alias("host"), F.col(quoted(html_col)).alias("html"),
                        F.struct(*[F.col(quoted(c)) for c in pages.columns if c != html_col]).alias("row"))
    if winners.count() <= BROADCAST_HOSTS:
        joined = base.join(F.broadcast(winners), "host", "left")
    else:  # salted, so that no task gets a whole large host
        salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = base.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    out = T.StructType([base.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("path", T.StringType())])
    return joined.select("html", "winners", "row").mapInArrow(_extract, out)
