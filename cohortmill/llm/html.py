"""Main text of web pages by equivalence-class template deduction.

A page is a row of tokens, told apart by their role: the tags on the path to them, with class and
id, and for text the text itself. Over the pages of a host each token has an occurrence vector: how
often each page holds it. Two additive hashes of that vector, summed in a partial aggregation, stand
for it, so that a host with a third of all pages is summed like any other. Tokens of equal vectors
form an equivalence class; it is valid if it has two tokens or more, stands on at least half of
the host's pages, and nests: what encloses its tokens, but for its own elements, is of one other class. Nested classes are the host's template. The template's slot
for content is the one that an article or main element opens, or else the deepest that holds most
of the host's text that is not template. What a page has in that slot, without the template's own
text outside articles, is its main text. A page that lacks the slot, or whose host shows too few
pages for a template, is read by its own elements.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are
known by element, role, class and id. Character references are decoded, white space within a block
becomes one space, blocks are joined by one space. Null or empty html gives the empty text; null
urls share a host. Rows that repeat are extracted row by row; very long pages are read whole; ties between slots go to the larger token. An empty table gives
no rows. Further columns are not read.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

#: A host's pages for a template, at least; the share of them that a class must stand on; the share of a host's free text
#: that a slot without an article element must hold; templates up to this many bytes are broadcast, larger ones joined.
LEAST_PAGES, SUPPORT, MASS, BROADCAST_BYTES = 4, 0.5, 0.6, 8 << 20

# Elements of HTML by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript noembed xmp template".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
AWAY = frozenset("nav footer aside form script style textarea title iframe noscript noembed xmp template head button select svg canvas object menu dialog".split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
AWAY_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo|banner|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|newsletter|subscribe|signup|sidebar|side-bar|menu|navbar|navigation|nav|breadcrumbs?|masthead|site-header|page-header|header|footer|comments?|comment-list|commentlist|respond|replies|disqus|share|sharing|social|related|recommended|widget)(?:$|[\s_-])",
    re.IGNORECASE,
)
# The same within an article, where a name must be a whole class or id; its own headings, notes and figures are content.
AWAY_INSIDE = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices notification popup modal newsletter subscribe signup sidebar side-bar menu navbar navigation nav breadcrumb breadcrumbs comment comments comment-list commentlist respond replies disqus share sharing social related recommended widget".split())

_NAME, _SPECIAL = re.compile(r"</?([a-zA-Z][^\s/>]*)"), re.compile("[>\"']")
# One attribute after the other, so that names within values or within longer names do not count.
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_MARKS = frozenset(("class", "id", "role", "hidden", "itemprop"))


def marks_of(attributes: str) -> dict[str, str]:
    """The marks among an element's attributes, by lower-case name; the first of a name counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        if (name := m[1].lower()) in _MARKS:
            out.setdefault(name, m[2] or m[3] or m[4] or "")
    return out


def away_by_name(named: str, article: bool) -> bool:
    """Whether class and id say that an element is no content."""
    return any(n.lower() in AWAY_INSIDE for n in named.split()) if article else bool(AWAY_NAMES.search(named))


def host(url):
    """The host of a URL column; null for a null URL."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


class Ends:
    """Where the tags of a page end. Each stretch of it is looked at once, whatever quotes are left open: what follows a closed quote is remembered."""

    def __init__(self, page: str):
        self.page, self.after, self.gap, self.last = page, {}, (0, -1), page.rfind(">")

    def special(self, at: int) -> int:
        """The next of > " ' from ``at`` on, or -1."""
        low, high = self.gap
        if not low <= at <= high:
            m = _SPECIAL.search(self.page, at)
            high = m.start() if m else len(self.page)
            self.gap = (at, high)
        return high if high < len(self.page) else -1

    def of(self, at: int) -> int:
        """The first > from ``at`` on that stands outside quotes; where there is none, the first one at all; -1 without any."""
        way, end, p = [], -1, at
        while True:
            if p in self.after:
                end = self.after[p]
                break
            way.append(p)
            i = self.special(p)
            if i < 0 or self.page[i] == ">":
                end = i
                break
            close = self.page.find(self.page[i], i + 1)
            if close < 0:
                break
            p = close + 1
        for x in way:
            self.after[x] = end
        return end if end >= 0 else self.page.find(">", at)


def events(page: str) -> Iterator[tuple]:
    """('open', name, attributes) | ('close', name, '') | ('text', text, '') of a page, in order, in linear time. A tag whose quotes do not close ends at the next >; without one, < is text, but for
    an unfinished tag at the end of the page."""
    at, n, ends, last_open = 0, len(page), Ends(page), page.rfind("<")
    while at < n:
        if page[at] != "<":
            end = page.find("<", at)
            end = n if end < 0 else end
            yield "text", page[at:end], ""
            at = end
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), at):
            end = page.find(">", at + 2)
            at = n if end < 0 else end + 1
            continue
        tag = _NAME.match(page, at) if at < ends.last else None
        if not tag:
            if at == last_open and at > ends.last and page[at + 1 : at + 2].isascii() and (page[at + 1 : at + 2].isalpha() or page[at + 1 : at + 2] == "/"):
                return
            yield "text", "<", ""
            at += 1
            continue
        end, name = ends.of(tag.end()), tag[1].lower()
        more, at = page[tag.end() : end], end + 1
        if page[tag.start() + 1] == "/":
            yield "close", name, ""
            continue
        yield "open", name, more
        if name in RAW:
            m = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.IGNORECASE).search(page, at)
            at = m.end() if m else n
            yield "close", name, ""


class Walk:
    """The elements and texts of one page, in order; each names the element around it by its number, so that depth costs nothing."""

    def __init__(self, page: str):
        self.opened: list[tuple[int, str, bool, bool, int]] = []  # role, name, away, opens an article, element around: each element met
        self.texts: list[tuple[int, str, bool, bool, int]] = []  # block, text, away, in an article, element around (-1: none)
        stack: list[tuple[str, int, bool, bool]] = []  # name, element, away, in an article
        held: dict[str, int] = {}  # how many elements of a name are open
        block = 0

        def pop() -> str:
            name = stack.pop()[0]
            held[name] -= 1
            return name

        for kind, name, more in events(page):
            _, around, away, article = stack[-1] if stack else ("", -1, False, False)
            if kind == "text":
                self.texts.append((block, name, away, article, around))
            elif kind == "open":
                if name in BLOCK or name in RAW:
                    block += 1
                    if name in BLOCK and any(s[0] == "p" for s in stack[-6:]):
                        while stack and pop() != "p":
                            pass
                    if name in ("article", "main") and stack and stack[-1][2] and not stack[-1][3]:
                        while stack and stack[-1][2]:  # an unclosed menu or the like ends where the article begins
                            pop()
                    elif name in ("li", "dd", "dt", "td", "th", "tr", "option") and stack and stack[-1][0] == name:
                        pop()
                elif name == "br":
                    self.texts.append((block, " ", away, article, around))
                _, around, away, article = stack[-1] if stack else ("", -1, False, False)
                marks = marks_of(more) if more else {}
                named = f"{marks.get('class', '')} {marks.get('id', '')}"
                role = zlib.crc32(f"{name}|{named}".encode(), self.opened[around][0] if around >= 0 else 0)
                is_main = name in ("article", "main") or marks.get("role") == "main" or marks.get("itemprop") == "articleBody"
                if not is_main and not away:
                    away = name in AWAY or (name == "header" and not article) or marks.get("role") in AWAY_ROLES or "hidden" in marks or (named != " " and name not in ("html", "body") and away_by_name(named, article))
                article = article or (is_main and not away)
                self.opened.append((role, name, away, is_main and not away, around))
                if name not in VOID and not more.endswith("/"):
                    stack.append((name, len(self.opened) - 1, away, article))
                    held[name] = held.get(name, 0) + 1
            else:
                if name in BLOCK or name in RAW:
                    block += 1
                if held.get(name):
                    while pop() != name:
                        pass

    def role(self, element: int) -> int:
        return self.opened[element][0] if element >= 0 else 0

    def text_role(self, text: str, around: int) -> int:
        return zlib.crc32(text.encode("utf-8", "surrogatepass"), self.role(around)) | 1 << 32

    def within(self, slot: int) -> list[bool]:
        """For each element, whether it is of the role ``slot`` or lies in one that is."""
        out: list[bool] = []
        for role, _, _, _, around in self.opened:
            out.append(role == slot or (around >= 0 and out[around]))
        return out


def occurrences(page: str) -> dict[int, list]:
    """token -> [times, kind, depth, characters of free text below, token of the element above]; kind 0: text, 1: element, 2: element that holds an article, 3: element away."""
    walk, out = Walk(page), {}
    depth: list[int] = []
    for _, _, _, _, around in walk.opened:
        depth.append(depth[around] + 1 if around >= 0 else 0)
    # What texts weigh is handed up from each element to the one around it, which was opened before it.
    mass, some = [0] * len(depth), [False] * len(depth)
    for _, text, away, _, around in walk.texts:
        if around >= 0 and not text.isspace():
            some[around] = True
            mass[around] += 0 if away else len(text)
    for e in range(len(depth) - 1, -1, -1):
        if (up := walk.opened[e][4]) >= 0:
            mass[up] += mass[e]
            some[up] = some[up] or some[e]
    for e, (role, _, away, main, around) in enumerate(walk.opened):
        t = out.setdefault(role, [0, 3 if away else 2 if main else 1, 0, 0, walk.role(around)])
        t[0] += 1
        t[3] += mass[e]
        if some[e]:
            t[2] = depth[e]
    for _, text, _, _, around in walk.texts:
        if not text.isspace():
            t = out.setdefault(walk.text_role(text.strip(), around), [0, 0, depth[around] + 1 if around >= 0 else 0, 0, walk.role(around)])
            t[0] += 1
    return out


def templates(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> host, slot, fixed: a row for each host that shows a template. slot: the role of the element that
    holds the content; fixed: the text tokens of valid classes. A valid class stands on half of the pages, so both are bounded by
    twice the tokens of a page."""

    def run(batches):
        for batch in batches:
            seen: dict[tuple, list] = {}
            hosts: dict = {}
            for page_id, h, page in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("page_id", "host", "html")), strict=True):
                hosts[h] = hosts.get(h, 0) + 1
                for token, (times, kind, depth, mass, above) in occurrences(page or "").items():
                    key = f"{page_id}:{times}".encode()
                    s = seen.setdefault((h, token), [kind, depth, 0, 0, 0, 0, above])
                    s[1] = max(s[1], depth)
                    s[2] += 1
                    s[3] += zlib.crc32(key)
                    s[4] += zlib.adler32(key) ^ zlib.crc32(key, 7)
                    s[5] += mass
            rows = [(h, t, *s) for (h, t), s in seen.items()] + [(h, -1, 9, 0, n, 0, 0, 0, 0) for h, n in hosts.items()]
            names = ["host", "token", "kind", "depth", "pages", "v1", "v2", "mass", "above"]
            types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    cells = pages.select("page_id", F.coalesce(host("url"), F.lit("")).alias("host"), "html").mapInArrow(run, "host string, token long, kind int, depth int, pages long, v1 long, v2 long, mass long, above long")
    tokens = cells.groupBy("host", "token").agg(F.max("kind").alias("kind"), F.max("depth").alias("depth"), F.max("above").alias("above"), *[F.sum(c).alias(c) for c in ("pages", "v1", "v2", "mass")])
    tokens = materialise(tokens, "tokens")
    sizes = tokens.where("token = -1").select("host", F.col("pages").alias("n")).where(F.col("n") >= LEAST_PAGES)
    frequent = tokens.where("token >= 0").join(sizes, "host").where(F.col("pages") >= SUPPORT * F.col("n"))
    classes = frequent.groupBy("host", "n", "pages", "v1", "v2").agg(F.collect_list(F.struct("token", "kind", "depth", "mass", "above")).alias("members")).where(F.size("members") >= 2)
    named = classes.select("host", "n", "pages", F.struct("pages", "v1", "v2").alias("class"), F.explode("members").alias("m")).select("host", "n", "pages", "class", "m.*")
    # A class nests if all that encloses its tokens, but for its own elements, is of one class.
    outer = named.select("host", F.col("token").alias("above"), F.col("class").alias("outer"))
    around = named.join(outer, ["host", "above"], "left").where(~F.col("class").eqNullSafe(F.col("outer")))
    loose = around.groupBy("host", "class").agg(F.count_distinct(F.coalesce(F.col("outer"), F.struct(F.lit(0).cast("long").alias("pages"), F.lit(0).cast("long").alias("v1"), F.lit(0).cast("long").alias("v2")))).alias("k")).where("k > 1").select("host", "class")
    valid = named.join(loose, ["host", "class"], "left_anti")
    # Of an article's elements the outermost; of others the deepest that holds most of the free text.
    best = valid.groupBy("host").agg(F.max("mass").alias("all"))
    fit = valid.join(best, "host").where((F.col("kind") == 2) | ((F.col("kind") == 1) & (F.col("mass") >= MASS * F.col("all"))))
    order = F.struct((F.col("kind") == 2).alias("main"), F.when(F.col("kind") == 2, -F.col("depth")).otherwise(F.col("depth")), F.col("pages"), F.col("token"))
    slot = fit.groupBy("host").agg(F.max_by("token", order).alias("slot"))
    fixed = valid.where((F.col("kind") == 0) & (F.col("pages") == F.col("n"))).groupBy("host").agg(F.collect_set("token").alias("fixed"))
    return slot.join(fixed, "host", "left")


def main_text(page: str, slot: int | None = None, fixed: frozenset[int] = frozenset()) -> str:
    """The main text of a page: what the slot holds, or what the page's own elements show as content."""
    walk = Walk(page)
    kept = [t for t in walk.texts if not t[2]]
    inside = walk.within(slot) if slot is not None else []
    chosen = [t for t in kept if t[4] >= 0 and inside[t[4]]] if slot is not None else []
    if not any(t[1].strip() for t in chosen):
        chosen = [t for t in kept if t[3]]
    if not any(t[1].strip() for t in chosen) and not any(o[3] for o in walk.opened):
        chosen = kept
    blocks: dict[int, list[str]] = {}
    for block, text, _, article, around in chosen:
        if article or not fixed or walk.text_role(text.strip(), around) not in fixed:
            blocks.setdefault(block, []).append(text)
    done = (" ".join(html.unescape("".join(b)).split()) for b in blocks.values())
    return " ".join(b for b in done if b)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> page_id, url, text, n_chars."""
    pages = pages.select(F.col("page_id").cast("long"), "url", "html")
    known = materialise(templates(pages), "templates")
    held = known.agg(F.sum(64 + 8 * F.greatest(F.size("fixed"), F.lit(0)))).first()[0] or 0
    known = F.broadcast(known) if held <= BROADCAST_BYTES else known

    def run(batches):
        for batch in batches:
            ids, urls, pages_, slots, fixed = (batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "html", "slot", "fixed"))
            texts = [main_text(p or "", s, frozenset(f or ())) for p, s, f in zip(pages_.to_pylist(), slots.to_pylist(), fixed.to_pylist(), strict=True)]
            yield pa.record_batch([ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    joined = pages.withColumn("host", F.coalesce(host("url"), F.lit(""))).join(known, "host", "left").select("page_id", "url", "html", "slot", "fixed")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
