"""Articles and their parts from law pages.

Page structure: ``p.pDieu > a[name=code]`` with the title after the anchor, a note block
next to it, then ``p.pNoiDung`` with the body, attachment links and ``p.pChiDan`` with
related links. Pages are spread by Spark; only the walk over one page's marks is Python, and
pages without an article mark never leave the JVM.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import escape, unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import fixed
from ..dist import first_per, position_within
from ..functions import text as tx

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
        "track", "wbr"}


class _Node:
    __slots__ = ("tag", "attrs", "kids", "up", "at", "no", "last")

    def __init__(self, tag, attrs, up, no):
        self.tag, self.attrs, self.up, self.kids = tag, dict(attrs), up, []
        self.at = len(up.kids) if up is not None else 0
        self.no = self.last = no  # document order of the node and of its last descendant

    def text(self) -> str:
        out, todo = [], self.kids[::-1]
        while todo:                       # a page may nest deeper than calls may
            k = todo.pop()
            if isinstance(k, str):
                out.append(k)
            else:
                todo += k.kids[::-1]
        return "".join(out)

    def has_class(self, name) -> bool:
        return name in (self.attrs.get("class") or "").split()

    def following(self):
        """The next sibling, element or text."""
        rest = self.up.kids[self.at + 1:self.at + 2] if self.up is not None else []
        return rest[0] if rest else None

    def html(self) -> str:
        out, todo = [], [self]
        while todo:
            k = todo.pop()
            if isinstance(k, tuple):      # the end of an element
                out.append(k[0])
            elif isinstance(k, str):
                out.append(escape(k, quote=False))
            else:
                attrs = "".join(f' {n}="{escape(v or "")}"' for n, v in k.attrs.items())
                if k.tag in VOID:
                    out.append(f"<{k.tag}{attrs}/>")
                else:
                    out.append(f"<{k.tag}{attrs}>")
                    todo += [(f"</{k.tag}>",), *k.kids[::-1]]
        return "".join(out)


# What most pages consist of; the parser reads these as they stand.
PLAIN = re.compile(r"""([^<]+)|</([a-z][a-z0-9]*)>|<([a-z][a-z0-9]*)((?: [a-z]+=(?:'[^'&]*'|"[^"&]*"))*)>""")
PLAIN_ATTR = re.compile(r""" ([a-z]+)=(?:'([^']*)'|"([^"]*)")""")
RAW_TEXT = {"script", "style", "title", "textarea", "plaintext", "xmp", "iframe", "noembed", "noframes", "noscript"}


class _Tree(HTMLParser):
    def read(self, html: str) -> bool:
        """Take in a page of plain tags and texts; another one is left off at its first other mark."""
        end = 0
        for m in PLAIN.finditer(html):
            if m.start() != end:
                return False
            end = m.end()
            kind = m.lastindex
            if kind == 1:
                data = m[1]
                self.handle_data(unescape(data) if "&" in data else data)
            elif kind == 2:
                self.handle_endtag(m[2])
            elif m[3] in RAW_TEXT:
                return False
            else:
                self.handle_starttag(m[3], [(n, a or b) for n, a, b in PLAIN_ATTR.findall(m[4])] if m[4] else ())
        return end == len(html)

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.here = _Node("", [], None, -1)
        self.flat = []

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, attrs, self.here, len(self.flat))
        self.here.kids.append(node)
        self.flat.append(node)
        if tag not in VOID:
            self.here = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._leave(self.here.up)

    def handle_endtag(self, tag):
        node = self.here
        while node.up is not None and node.tag != tag:
            node = node.up
        if node.up is not None:
            self._leave(node.up)

    def _leave(self, outer):
        while self.here is not outer:
            self.here.last = len(self.flat) - 1
            self.here = self.here.up

    def finish(self):
        self.close()
        while self.here.up is not None:
            self._leave(self.here.up)

    def handle_data(self, data):
        kids = self.here.kids
        if kids and isinstance(kids[-1], str):
            kids[-1] += data
        else:
            kids.append(data)


def _articles(html: str):
    tree = _Tree()
    if not tree.read(html):
        tree = _Tree()
        tree.feed(html)
    tree.finish()
    links = lambda n: [x for x in tree.flat[n.no + 1:n.last + 1] if x.tag == "a"]
    bodies = [n for n in tree.flat if n.tag == "p" and n.has_class("pNoiDung")]
    starts = [n.no for n in bodies]
    for anchor in tree.flat:
        if anchor.tag != "a" or not anchor.attrs.get("name") or not anchor.up.has_class("pDieu"):
            continue
        title, note = anchor.following(), anchor.up.following()
        nearest = bisect_right(starts, anchor.up.no)
        if nearest == len(bodies):
            continue
        body = bodies[nearest]
        lines, tables, files, related = [], [], [], []
        for kid in body.kids:
            if not isinstance(kid, str) and kid.tag == "table":
                tables.append(kid.html())
            else:
                lines.append((kid if isinstance(kid, str) else kid.text()).strip() + "\n")
        after = body.following()
        while isinstance(after, _Node) and after.tag == "a":
            files.append(after.attrs.get("href"))
            after = after.following()
        if isinstance(after, _Node) and after.tag == "p" and after.has_class("pChiDan"):
            related = [n.attrs["onclick"] for n in links(after) if n.attrs.get("onclick")]
        link = note_text = None
        if note is not None:
            note_text = note if isinstance(note, str) else note.text()
            inner = links(note) if isinstance(note, _Node) else []
            link = inner[0].attrs.get("href") if inner else None
        yield (anchor.attrs["name"], title if isinstance(title, str) else
               title.text() if title is not None else None,
               "".join(lines), note_text, link, tables, files, related)


OUT_CHARS = 1 << 20                         # of articles that a worker holds

ARTICLE_TYPE = ("page_id {}, pos int, mapc string, ten string, noidung string, vbqppl string, "
                "vbqppl_link string, tables array<string>, files array<string>, "
                "onclicks array<string>")


def extract_articles(pages: DataFrame, page_id="page_id", html="html") -> DataFrame:
    """One row per article anchor, with its note, tables, files and raw related handlers.

    Marked pages are dealt out by their id before the walk: it takes far longer than moving a page,
    and the files of a small or oddly cut input would leave most tasks without pages. A worker holds
    one page and ``OUT_CHARS`` of its articles besides the batch it reads, whose size ``prepare`` bounds.
    """
    key_type = pages.schema[page_id].dataType.simpleString()
    result = T.StructType.fromDDL(ARTICLE_TYPE.format(key_type))

    def walk(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(result)
        out, held = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                pid = batch.column(0)[i].as_py()
                for pos, art in enumerate(_articles(batch.column(1)[i].as_py())):
                    out.append((pid, pos, *art))
                    held += 500 + sum(len(x) for x in art[:5] if x) + sum(len(x) for t in art[5:] for x in t if x)
                    if held >= OUT_CHARS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    marked = pages.select(page_id, html).filter(F.contains(html, F.lit("pDieu")))
    return marked.repartition(page_id).mapInArrow(walk, result)


def extract_source_note(articles: DataFrame) -> DataFrame:
    return articles.select("page_id", "mapc", "vbqppl", "vbqppl_link")


def extract_tables(articles: DataFrame) -> DataFrame:
    return articles.select(F.col("mapc").alias("dieu_id"),
                           F.posexplode("tables").alias("pos", "html"))


def extract_files(articles: DataFrame) -> DataFrame:
    return articles.select(F.col("mapc").alias("dieu_id"),
                           F.posexplode("files").alias("pos", "link")).withColumn("path", F.lit(""))


def extract_related(articles: DataFrame) -> DataFrame:
    """(article, related code): the text in the first parentheses of each handler."""
    pairs = articles.select(F.col("mapc").alias("dieu_id1"), F.explode("onclicks").alias("_h"))
    code = F.replace(F.regexp_extract("_h", r"\((.*?)\)", 1), F.lit("'"), F.lit(""))
    return pairs.filter(F.col("_h").rlike(r"\(.*?\)")).select("dieu_id1", code.alias("dieu_id2"))


# ---- forms that need no page walk -----------------------------------------------------

def page_title(html="html") -> Column:
    return F.regexp_extract(F.col(html), r"(?is)<title[^>]*>(.*?)</title>", 1)


def page_links(pages: DataFrame, page_id="page_id", html="html") -> DataFrame:
    """Every anchor's href with its position."""
    hrefs = F.regexp_extract_all(F.col(html), F.lit(r"(?i)<a\s[^>]*?href=[\"']([^\"']*)[\"']"), F.lit(1))
    return pages.select(page_id, F.posexplode(hrefs).alias("pos", "href"))


def split_nodes(nodes: DataFrame, name="ten") -> tuple[DataFrame, DataFrame]:
    """(chapters, articles) of the page tree."""
    chapter = F.coalesce(F.col(name).startswith(fixed.CHAPTER_PREFIX), F.lit(False))
    return nodes.filter(chapter), nodes.filter(~chapter)


def assign_chapter(articles: DataFrame, chapters: DataFrame, by="demuc_id", code="mapc",
                   pos="pos") -> DataFrame:
    """The only chapter of the subtopic, else the first whose code starts the article's.

    Prefixes become equality: each article is looked up by its own prefixes at the lengths
    that chapter codes of the subtopic have, so no article meets every chapter.
    """
    ch = chapters.select(F.col(by).alias("_by"), F.col(code).alias("_ch"), F.col(pos).alias("_cp"))
    per = ch.groupBy("_by").agg(F.count(F.lit(1)).alias("_n"), F.min("_ch").alias("_only"),
                                F.collect_set(F.length("_ch")).alias("_lens"))
    base = articles.join(per, articles[by] == F.col("_by"), "left").drop("_by")
    tries = (base.filter("_n > 1")
             .select(by, F.col(code).alias("_code"), F.explode("_lens").alias("_len"))
             .filter(F.col("_len") <= F.length("_code"))
             .withColumn("_prefix", F.substring("_code", F.lit(1), F.col("_len"))))
    found = tries.join(ch, (tries[by] == ch["_by"]) & (F.col("_prefix") == F.col("_ch")))
    found = first_per(found.select(tries[by].alias("_fby"), "_code", "_ch", "_cp").distinct(),
                      ["_fby", "_code"], ["_cp"])
    out = base.join(found, base[by].eqNullSafe(F.col("_fby")) & (base[code] == F.col("_code")),
                    "left")
    return (out.withColumn("chapter_id", F.when(F.col("_n") == 1, F.col("_only"))
                           .otherwise(F.col("_ch")))
            .drop("_n", "_only", "_lens", "_fby", "_code", "_ch", "_cp"))


def article_position(df: DataFrame, page="page_id", pos="pos", name="stt") -> DataFrame:
    """0-based position among the accepted articles of a page."""
    return position_within(df, page, pos, name)


def match_nodes(pages: DataFrame, nodes: DataFrame, page_key="page_id",
                node_key="demuc_id") -> tuple[DataFrame, DataFrame]:
    """(page, node) matches and the pages without any node."""
    cond = pages[page_key] == nodes[node_key]
    return pages.join(nodes, cond), pages.join(nodes, cond, "left_anti")


def distinct_item_ids(df: DataFrame, link="vbqppl_link") -> DataFrame:
    """Distinct external document ids named in links that also carry a fragment."""
    item = tx.nonblank(F.regexp_extract(F.col(link), r"ItemID=(\d+).*#(.*)", 1))
    return df.select(item.alias("item_id")).filter("item_id IS NOT NULL").distinct()


def chapter_ordinals(chapters: DataFrame, chimuc="chimuc") -> tuple[DataFrame, DataFrame]:
    """Chapters with their ordinal, and those whose numeral cannot be read."""
    tagged = chapters.withColumn("stt", tx.roman_ordinal(chimuc))
    return tagged.filter("stt IS NOT NULL"), tagged.filter("stt IS NULL")
