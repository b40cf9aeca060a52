"""HTML extraction by wrapper induction: what pages of a host have in common is template, what varies is content.

A page is read into a tree of its block elements, whose text between two block boundaries is a block. Neighbours of one
shape are folded into one node, as are runs of plain text elements, so that lists and articles of any length have one
shape. The commonest folded tree of a host is its wrapper; each other one is aligned with it by simple tree matching, which
gives every node its place in the wrapper. A place whose text is the same on most pages of the host is template; the others
are slots, and their text is content unless its element says that it is something else (a menu, an advert, a form).
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillspark.llm.common import slices, table, workers_find_us, written

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>|<[!?][^<>]*>""", re.S)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|style|itemprop|aria-hidden|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Elements that are not inline: a block of text ends where one begins or ends.
BLOCKS = frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog dir div dl dt embed fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html iframe legend li main menu nav noscript "
    "object ol optgroup option p pre search section select summary svg table tbody td template tfoot th thead tr ul video audio".split()
)
VOID = frozenset("area base br col hr img input link meta param source track wbr embed".split())
RAW = frozenset("script style title textarea xmp noembed noframes".split())
#: Plain text elements: runs of them are one node, however many.
FLOW = frozenset("p h2 h3 h4 h5 h6 blockquote pre address figcaption".split())
#: What an open element closes when it begins, and where the search for it ends.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements and words of classes, ids and roles that are never the article's text.
CHROME = frozenset("nav footer aside noscript template iframe svg button select option optgroup dialog menu object canvas video audio embed search head".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar footer toolbar topbar cookie cookies consent gdpr notice notices notification "
    "popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended comment comments commentlist respond disqus reply replies pagination pager widget copyright hidden contentinfo complementary".split()
)
#: These are so only outside of an article.
HEADINGS = frozenset("header masthead banner".split())
NOT, HEADING, FORM, ARTICLE, MAIN = 1, 2, 4, 8, 16
#: Characters of wrappers that are sent to all tasks; more are joined by host.
BROADCAST = 32 << 20
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@lru_cache(maxsize=1 << 16)
def kind(tag: str, attributes: str) -> tuple[str, int]:
    """The label of an element, by its tag, classes and id without their numbers, and what it says of its text."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    label = ".".join([tag, *sorted({re.sub(r"\d+", "0", n) for n in names})])
    flags = NOT if tag in CHROME else FORM if tag == "form" else HEADING if tag == "header" else ARTICLE if tag == "article" else MAIN if tag == "main" else 0
    role, said = found.get("role", "").lower(), set()
    for n in [*names, role]:
        words = [w.lower() for w in WORD.findall(n)]
        if not words or words[0] not in ("has", "no", "with", "without"):
            said.update(words)
    if tag not in ("html", "body", "main"):
        flags |= (NOT if said & WORDS else 0) | (HEADING if said & HEADINGS else 0)
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        flags |= NOT
    flags |= (MAIN if role == "main" else 0) | (ARTICLE if role == "article" or "articlebody" in found.get("itemprop", "").lower() else 0)
    return label, flags


class Page:
    """A page's block elements in document order (parent, label, tag, flags) and its blocks (node, text, letters in links)."""

    def __init__(self, source: str):
        self.parent, self.labels, self.tags, self.flags = [-1], ["#"], ["#"], [0]
        self.blocks: list[tuple[int, str, int]] = []
        self.read(source)

    def read(self, source: str) -> None:
        stack, links, depth, opened = [0], [False], {}, False
        pieces: list[str] = []
        linked, at, search, end = 0, 0, TAG.search, len(source)

        def text(s: str) -> None:
            nonlocal linked
            if "&" in s:
                s = entities.unescape(s)
            pieces.append(s)
            if opened:
                linked += len(s)

        def flush() -> None:
            nonlocal linked
            if pieces:
                if s := " ".join("".join(pieces).split()):
                    self.blocks.append((stack[-1], s, linked))
                pieces.clear()
                linked = 0

        def close(to: int) -> None:
            nonlocal opened
            flush()
            while len(stack) > to:
                depth[self.tags[stack.pop()]] -= 1
                opened = links.pop()

        def closed(tags: set[str], barrier: set[str]) -> None:
            if any(depth.get(t) for t in tags):
                for k in range(len(stack) - 1, 0, -1):
                    if (t := self.tags[stack[k]]) in tags:
                        return close(k)
                    if t in barrier:
                        return

        while at < end:
            m = search(source, at)
            if m is None:
                text(source[at:])
                break
            if m.start() > at:
                text(source[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            tag, ends = name.lower(), m[1] or m[4]
            if tag in RAW:
                if not ends:
                    stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
                    at = stop.end() if stop else end if tag in ("script", "style") else at
                continue
            if tag not in BLOCKS:
                if tag == "a":
                    opened = not ends
                elif tag == "br":
                    pieces.append(" ")
                elif tag == "hr":
                    flush()
                continue
            if ends:
                if depth.get(tag):
                    closed({tag}, CLOSES[tag][1] if tag in CLOSES else set())
                else:
                    flush()
                continue
            flush()
            if depth.get("head") and tag not in ("noscript", "template", "object"):
                closed({"head"}, set())
            if depth.get("p"):
                closed({"p"}, {"button", "td", "th", "caption", "object"})
            if tag in CLOSES:
                closed(*CLOSES[tag])
            label, flags = kind(tag, m[3] or m[6] or "")
            self.parent.append(stack[-1])
            self.labels.append(label)
            self.tags.append(tag)
            self.flags.append(flags)
            if tag not in VOID:
                stack.append(len(self.parent) - 1)
                depth[tag] = depth.get(tag, 0) + 1
                links.append(opened)
        flush()

    def marked(self) -> list[int]:
        """For each node NOT, if its text can't be content, and ARTICLE and MAIN, if it stands in one. A form is content if
        it holds an article or most of the page's text, and a header is if it stands in an article."""
        n, parent, forms = len(self.parent), self.parent, set()
        if any(f & FORM for f in self.flags):
            size, holds = [0] * n, [f & (ARTICLE | MAIN) for f in self.flags]
            for k, s, _ in self.blocks:
                size[k] += len(s)
            for k in range(n - 1, 0, -1):
                size[parent[k]] += size[k]
                holds[parent[k]] |= holds[k]
            forms = {k for k, f in enumerate(self.flags) if f & FORM and not holds[k] and 2 * size[k] <= size[0]}
        out = [0] * n
        for k in range(1, n):
            f, above = self.flags[k], out[parent[k]]
            bad = f & NOT or k in forms or (f & HEADING and not above & (ARTICLE | MAIN))
            out[k] = above | (f & (ARTICLE | MAIN)) | (NOT if bad else 0)
        return out

    def folded(self) -> tuple[str, list[int]]:
        """The folded tree, a line `parent label` a node, and the place of each node of the page in it."""
        n = len(self.parent)
        below: list[list[int]] = [[] for _ in range(n)]
        for k in range(1, n):
            below[self.parent[k]].append(k)
        shapes: dict[tuple, int] = {}
        shape, groups = [0] * n, [[] for _ in range(n)]
        for k in range(n - 1, -1, -1):
            for c in below[k]:
                if groups[k] and shape[groups[k][-1][-1]] == shape[c]:
                    groups[k][-1].append(c)
                else:
                    groups[k].append([c])
            flow = self.tags[k] in FLOW and all(shape[c] == -1 for c in below[k])
            shape[k] = -1 if flow else shapes.setdefault((self.labels[k], *(shape[g[0]] for g in groups[k])), len(shapes))
        lines, place, todo = [], [0] * n, [(-1, [0])]
        while todo:
            up, same = todo.pop()
            here = len(lines)
            flow = shape[same[0]] == -1
            lines.append(f"{up} {'~' if flow else self.labels[same[0]]}")
            if flow:
                inside = list(same)
                while inside:
                    k = inside.pop()
                    place[k] = here
                    inside += below[k]
                continue
            for k in same:
                place[k] = here
            for part in reversed(list(zip(*(groups[k] for k in same)))):
                todo.append((here, [c for g in part for c in g]))
        return "\n".join(lines), place


class Folded:
    def __init__(self, text: str):
        rows = [line.split(" ", 1) for line in text.split("\n")]
        self.labels = [r[1] for r in rows]
        self.below: list[list[int]] = [[] for _ in rows]
        for k, r in enumerate(rows[1:], 1):
            self.below[int(r[0])].append(k)


def weighed(a: list[int], b: list[int], weight: dict[tuple[int, int], int]) -> list[list[int]]:
    """Best sums of weights of pairs of a and b in order, for all their beginnings."""
    rows = [[0] * (len(b) + 1)]
    for x in a:
        last, row = rows[-1], [0]
        for j, y in enumerate(b):
            w = weight.get((x, y), 0)
            best = last[j + 1] if last[j + 1] > row[j] else row[j]
            row.append(last[j] + w if w and last[j] + w > best else best)
        rows.append(row)
    return rows


@lru_cache(maxsize=512)
def matched(wrapper: str, other: str) -> list[int]:
    """The node of the wrapper for each node of another folded tree, or -1, by simple tree matching: roots of one label
    match, and of their children those pairs, in order, that give most matched nodes."""
    if wrapper == other:
        return list(range(wrapper.count("\n") + 1))
    a, b = Folded(wrapper), Folded(other)
    weight: dict[tuple[int, int], int] = {}
    todo = [(0, 0)]
    while todo:
        x, y = todo[-1]
        if (x, y) in weight:
            todo.pop()
            continue
        pairs = [(i, j) for i in a.below[x] for j in b.below[y] if a.labels[i] == b.labels[j]]
        if missing := [p for p in pairs if p not in weight]:
            todo += missing
            continue
        weight[x, y] = 1 + (weighed(a.below[x], b.below[y], weight)[-1][-1] if pairs else 0)
        todo.pop()
    out, todo = [-1] * len(b.labels), [(0, 0)]
    while todo:
        x, y = todo.pop()
        out[y] = x
        left, right = a.below[x], b.below[y]
        rows, i, j = weighed(left, right, weight), len(left), len(right)
        while i and j:
            w = weight.get((left[i - 1], right[j - 1]), 0)
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                assert w
                i, j = i - 1, j - 1
                todo.append((left[i], right[j]))
    return out


def number(s: str) -> int:
    """A signed 64-bit digest."""
    k = xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"))
    return k - (1 << 64) if k >> 63 else k


def places(page: Page, wrapper: str | None, marks: list[int]) -> tuple[dict[int, int], list[int]]:
    """The digest of what stands at each place of the wrapper that can be content, and each node's place, or -1."""
    if not wrapper:
        return {}, [-1] * len(page.parent)
    tree, place = page.folded()
    to = matched(wrapper, tree)
    at, held = [to[p] for p in place], {}
    for k, s, _ in page.blocks:
        if at[k] >= 0 and not marks[k] & NOT:
            held.setdefault(at[k], []).append(s)
    return {p: number("\n".join(s)) for p, s in held.items()}, at


def extracted(page: Page, wrapper: str | None, template: dict[int, int]) -> str:
    """The blocks of content: of the articles if the page marks any with text, else of its main parts, else of the smallest
    element with most of the letters outside of links, and headings before it."""
    marks = page.marked()
    held, at = places(page, wrapper if template else None, marks)
    gone = {p for p, digest in held.items() if template.get(p) == digest}
    blocks = [b for b in page.blocks if not marks[b[0]] & NOT and at[b[0]] not in gone]
    for region in (ARTICLE, MAIN):
        if any(marks[b[0]] & region for b in blocks):
            return "\n".join(b[1] for b in blocks if marks[b[0]] & region)
    blocks = [b for b in blocks if 2 * b[2] <= len(b[1])]
    size, inside = [0] * len(page.parent), [False] * len(page.parent)
    for k, s, _ in blocks:
        size[k] += len(s)
    for k in range(len(size) - 1, 0, -1):
        size[page.parent[k]] += size[k]
    region = max((k for k, s in enumerate(size) if 5 * s >= 3 * size[0] and page.tags[k] in ("#", "html", "body", "div", "section", "td", "center", "form")), default=0)
    for k in range(len(size)):
        inside[k] = k == region or (k > 0 and inside[page.parent[k]])
    return "\n".join(s for k, s, _ in blocks if inside[k] or (k < region and page.tags[k] == "h1"))


def host(url: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"://([^/?#]*)", 1))


def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html"):
            found = [Page(h).folded()[0] for h in part["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["host"], pa.array(found, pa.string())], names=["host", "wrapper"])


def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, place, value and page: a row for each place with text; page is a digest of all that the page may have as
    content, so that copies count once."""
    for batch in batches:
        for part in slices(batch, "html"):
            rows = []
            for h, source, wrapper in zip(*(part[c].to_pylist() for c in ("host", "html", "wrapper"))):
                page = Page(source)
                marks = page.marked()
                whole = number("\n".join(s for k, s, _ in page.blocks if not marks[k] & NOT))
                rows += [(h, p, v, whole) for p, v in places(page, wrapper, marks)[0].items()]
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 4, kinds)], names=["host", "place", "value", "page"])


def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html"):
            found = []
            for source, wrapper, at, value in zip(*(part[c].to_pylist() for c in ("html", "wrapper", "places", "values"))):
                found.append(extracted(Page(source), wrapper, dict(zip(at or [], value or []))))
            yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def by_host(pages: DataFrame, wrappers: DataFrame, most: int) -> DataFrame:
    """pages with their host's row of wrappers, if any; a small table goes to all tasks, else both meet by host."""
    size = wrappers.agg(F.sum(F.length("wrapper") + 100)).first()[0] or 0
    return pages.join(F.broadcast(wrappers) if size <= most else wrappers, "host", "left")


def with_texts(pages: DataFrame, least: int = 3, most: int = BROADCAST) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages (page_id, url, html).

    A null or empty html has an empty text. A place is template where at least `least` pages of the host that differ in
    their content have the same text there, and these are over half of those with any. A url without host has no wrapper:
    its page is judged alone, as are single pages of a host. Repeated rows are each answered; pages are read whole, however
    long and however broken; other columns aren't read; an empty table gives an empty table. most: characters of wrappers
    that are sent to all tasks; beyond, pages and wrappers are joined by host."""
    spark = pages.sparkSession
    workers_find_us(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"), host("url").alias("host"))
    hosted = rows.filter("host <> ''").select("host", "html")
    counted = hosted.mapInArrow(trees, "host string, wrapper string").groupBy("host", "wrapper").agg(F.count("*").alias("n"))
    first = Window.partitionBy("host").orderBy(F.col("n").desc(), "wrapper")
    wrappers = written(counted.withColumn("k", F.row_number().over(first)).filter("k = 1").select("host", "wrapper"), "html-wrappers")
    seen = by_host(hosted, wrappers, most).mapInArrow(values, "host string, place int, value bigint, page bigint").distinct()
    votes = seen.groupBy("host", "place", "value").agg(F.count("*").alias("n"))
    places_ = votes.groupBy("host", "place").agg(F.sum("n").alias("all"), F.max_by("value", F.struct("n", "value")).alias("value"), F.max("n").alias("n"))
    template = places_.filter(f"n >= {least} AND 2 * n > all").groupBy("host").agg(F.collect_list(F.struct("place", "value")).alias("found"))
    template = template.select("host", F.col("found.place").alias("places"), F.col("found.value").alias("values"))
    known = written(wrappers.join(template, "host"), "html-templates")
    return by_host(rows, known, most).select("page_id", "url", "html", "wrapper", "places", "values").mapInArrow(texts, "page_id bigint, url string, text string, n_chars bigint")


def op13(spark, sf_dir: str) -> DataFrame:
    return with_texts(table(spark, sf_dir, "pages"))
