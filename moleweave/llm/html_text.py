"""Main text of web pages: elements that recur on many pages of a host are site template and go.

A first pass hashes the subtree of each block, inside articles too, and Spark counts, for each host, the distinct pages
that have it; versions of one page count about once. Subtrees on more than a number and a share of a host's pages are
deleted in the second pass, with menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments
that the markup names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moleweave.llm.common import cut, lookup, table
from moleweave.llm.near_duplicates import mix64

#: A subtree is template if more distinct pages of its host have it than this number and than this share of the host's pages.
TREE_PAGES, TREE_SHARE = 4, 0.01
#: The share for ``PIECES``.
PIECE_SHARE = 0.1
#: A page is told by the least hashes of its runs of three words under so many hash functions: of nearly equal pages most are equal.
PAGE_KEYS = 3
#: Articles are teasers if what stands beside them is more than so many times as long.
TEASERS = 3
#: Parts of tables, lists and sections, which recur in articles that are otherwise distinct; they count outside articles alone.
PIECES = frozenset("caption dd dt figcaption h1 h2 h3 h4 h5 h6 legend li optgroup option pre summary tbody td tfoot th thead tr".split())
#: Stands for the page itself in counts.
PAGE = 0

#: A comment, a declaration, or a tag up to its end; quotes count at the beginning of an attribute's value alone.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/<>]*+)((?>[\s/]++|[^\s/<>][^\s/<>=]*+(?>\s*+=\s*+(?>\"[^\"]*+\"|'[^']*+'|[^\s<>\"'][^\s<>]*+)?+)?+)*+)(>|\Z)?", re.S)
ATTRIBUTE = re.compile(r"([^\s/<>][^\s/<>=]*+)(?>\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s<>\"'][^\s<>]*+)?+)?+")
#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title iframe".split())
#: Elements of other vocabularies, in which a slash ends an element.
FOREIGN = frozenset("svg math".split())
#: Elements in which an opening tag ends none outside.
SCOPES = frozenset("template object svg math noscript".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: An opening tag of a key's set ends an open element of the key.
ENDS = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}, "head": {"body"}}
#: Elements that hold the article or are it; no subtree with one of these is template.
WHOLE = frozenset("html body article main".split())
#: Elements and words of class, id and role that are not the article.
DROP_TAGS = frozenset("nav footer aside form button select dialog menu head noscript template svg canvas object".split())
DROP_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments discussion disqus replies related recommended widget toolbar masthead copyright contentinfo complementary pagination pager search".split()
)
HEADERS = frozenset({"header", "masthead", "banner", "topbar"})
#: What may stand beside such a word in one class: a class with any other part says something else.
BESIDE = frozenset("left right top bottom upper lower inner outer main site page global primary secondary first last bar box area list item items section wrap wrapper container block group row column content body text title link links button buttons icon icons post posts article articles form field region zone slot unit module panel inline sticky fixed mobile desktop large small".split())
#: Classes, ids and roles of readers' comments and lists of them; articles in such an element go with it.
COMMENT_LISTS = frozenset("comment comments comment-body comment-content comment-item comment-list comment-section comments-area comments-list commentlist disqus replies reply".split())
PARTS = re.compile(r"[a-z]+")


def marks(attributes: str) -> Iterator[tuple[str, str]]:
    """Names and values of the attributes that tell what an element is for."""
    for name, value in ATTRIBUTE.findall(attributes):
        if (name := name.lower()) in ("class", "id", "role", "hidden", "aria-hidden", "style"):
            yield name, value.strip("\"'").lower()


def comments(attributes: str) -> bool:
    return any(name in ("class", "id", "role") and COMMENT_LISTS & set(value.replace("_", "-").split()) for name, value in marks(attributes))


def dropped(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is not part of the article; ``inside`` an article its header is."""
    if tag in DROP_TAGS or (tag == "header" and not inside):
        return True
    if not attributes or tag in ("html", "body"):
        return False
    if tag in ("article", "main"):
        return comments(attributes)
    words = DROP_WORDS - HEADERS if inside else DROP_WORDS | HEADERS
    for name, value in marks(attributes):
        if name in ("class", "id", "role"):
            # Whole classes: a word of the list, alone or with words of place and shape, numbers aside.
            for x in value.split():
                parts = set(PARTS.findall(x))
                if parts & words and parts <= words | BESIDE:
                    return True
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return True
    return False


class Page:
    """One pass over a page, with a frame for each open element and no tree."""

    def __init__(self, html: str, template: frozenset[int] = frozenset()) -> None:
        self.template, self.trees = template, set()
        #: Text, 2 in an article, 1 in a main element alone and 0 elsewhere, and the number of dropped elements around those.
        self.blocks: list[tuple[str, int, int]] = []
        self.text: list[str] = []
        self.frames: list[list] = []
        #: How many elements of each tag are open, and the places of blocks among the open elements.
        self.opened: Counter = Counter()
        self.open_blocks: list[int] = []
        self.articles = self.mains = self.foreign = 0
        self.read(html)

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text.clear()
        if text:
            self.blocks.append((text, 2 if self.articles else 1 if self.mains else 0, 0))

    def say(self, text: str) -> None:
        self.text.append(text)
        if self.frames:
            if plain := " ".join(text.split()):
                self.frames[-1][5].append(plain)

    def open(self, tag: str, attributes: str) -> None:
        while self.frames and tag in ENDS.get(self.frames[-1][0], ()):
            self.close()
        if tag in BLOCKS:
            # An open p ends also with inline elements in it that were left open.
            if self.open_blocks and self.frames[self.open_blocks[-1]][0] == "p":
                depth = self.open_blocks[-1]
                while len(self.frames) > depth:
                    self.close()
            self.flush()
        if tag in BLOCKS or tag in SCOPES:
            self.open_blocks.append(len(self.frames))
        drop = dropped(tag, attributes, self.articles > 0)
        self.articles += tag == "article" and not drop
        self.mains += tag == "main" and not drop
        self.foreign += tag in FOREIGN
        self.opened[tag] += 1
        # What is left out within a paragraph does not end it, so its text so far is put by.
        before = None
        if drop and tag not in BLOCKS:
            before, self.text = self.text, []
        self.frames.append([tag, attributes, drop, len(self.blocks), before, [], False, self.articles, self.mains])

    def close(self) -> None:
        tag, attributes, drop, blocks, before, parts, holds, articles, mains = self.frames.pop()
        self.opened[tag] -= 1
        self.foreign -= tag in FOREIGN
        if tag in BLOCKS or tag in SCOPES:
            self.open_blocks.pop()
        if tag in BLOCKS:
            self.flush()
        # Attributes are left out, as links and ids differ from page to page; the last bit tells pieces.
        tree = (xxhash.xxh64_intdigest("\0".join([tag, *parts])) - (1 << 63) | 1) ^ (tag not in PIECES)
        counted = bool(parts) and tag in BLOCKS and not holds and tag not in WHOLE and not (self.articles and tag in PIECES)
        if counted:
            self.trees.add(tree)
        if self.frames:
            self.frames[-1][6] |= holds or tag in ("article", "main")
            if parts:
                self.frames[-1][5].append(str(tree))
        if drop or (counted and tree in self.template):
            if len(self.blocks) > blocks:
                # Articles and main elements in it stay; those in a form rank with others, those in further elements after them.
                stays = holds and not articles and not comments(attributes)
                self.blocks[blocks:] = [(t, kind, n + (tag != "form")) for t, kind, n in self.blocks[blocks:] if stays and kind > (mains > 0)]
            self.text = before or []
        self.articles -= tag == "article" and not drop
        self.mains -= tag == "main" and not drop

    def read(self, html: str) -> None:
        at = 0
        while token := TOKEN.search(html, at):
            if token.start() > at:
                self.say(unescape(html[at:token.start()]))
            at = token.end()
            tag = (token[2] or "").lower()
            if not tag:
                continue
            if not token[4]:
                # Broken off by another tag or the page's end: markup only if it has an attribute's value.
                if "=" not in token[3]:
                    self.say(unescape(token[0]))
            elif token[1]:
                if self.opened[tag]:
                    while self.frames[-1][0] != tag:
                        self.close()
                    self.close()
            elif tag in RAW:
                end = re.compile(f"</{re.escape(tag)}\\b[^>]*>", re.I).search(html, at)
                at = end.end() if end else len(html)
            elif tag in VOID:
                if tag in ("br", "hr"):
                    self.say(" ")
            elif not (token[3].endswith("/") and (self.foreign or tag in FOREIGN)):
                self.open(tag, token[3])
        if at < len(html):
            self.say(unescape(html[at:]))
        while self.frames:
            self.close()
        self.flush()

    def article(self) -> str:
        """The blocks of the articles in the fewest dropped elements and of main elements in no more; without any, of the page."""
        least = {kind: min((n for _, k, n in self.blocks if k == kind), default=None) for kind in (1, 2)}
        if least[1] is None and least[2] is None:
            return "\n\n".join(text for text, *_ in self.blocks)
        mains = least[1] is not None and (least[2] is None or least[1] <= least[2])
        chosen = [text for text, kind, n in self.blocks if kind and n == least[kind] and (kind == 2 or mains)]
        beside = [text for text, kind, _ in self.blocks if not kind]
        return "\n\n".join(beside if sum(map(len, beside)) > TEASERS * sum(map(len, chosen)) else chosen)


def page_keys(text: str) -> list[int]:
    words = text.split()
    runs = np.array([xxhash.xxh64_intdigest(" ".join(words[i:i + 3])) for i in range(max(1, len(words) - 2))], np.uint64)
    return [int(mix64(runs, k + 1).min()) - (1 << 63) for k in range(PAGE_KEYS)]


@F.pandas_udf(T.StructType([T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("trees", T.ArrayType(T.LongType()))]))
def page_trees(html: pd.Series) -> pd.DataFrame:
    """What tells a page's text before templates go, and the hashes of its subtrees."""
    pages = [Page(x or "") for x in html]
    return pd.DataFrame({"keys": [page_keys(p.article()) for p in pages], "trees": [[PAGE, *sorted(p.trees)] for p in pages]})


@F.pandas_udf(T.StringType())
def page_text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for html, trees in batches:
        yield pd.Series([Page(h or "", frozenset() if t is None else frozenset(t.tolist())).article() for h, t in zip(html, trees, strict=True)], dtype=object)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def template_trees(pages: DataFrame) -> DataFrame:
    """(host, trees): hashes of the subtrees that recur on many distinct pages of a host.

    Pages count by keys of their text, so that an article under several addresses, or in several versions, is no template:
    a subtree is on as many pages as the most that one of the keys tells apart. Each page gives each hash once, and counts
    are summed before the shuffle. A host has no more templates than a share of its pages' subtrees.
    """
    seen = pages.select(host_of(F.col("url")).alias("host"), F.explode(F.array(page_trees("html"))).alias("x")).select("host", "x.keys", F.explode("x.trees").alias("tree"))
    seen = seen.select("host", "tree", F.posexplode("keys").alias("k", "key")).distinct()
    counts = seen.groupBy("host", "tree", "k").agg(F.count("*").alias("n")).groupBy("host", "tree").agg(F.max("n").alias("n"))
    counts = cut(counts.where((F.col("n") > TREE_PAGES) | (F.col("tree") == PAGE)))
    hosts = counts.where(F.col("tree") == PAGE).select("host", F.col("n").alias("n_pages"))
    found = lookup(counts.where(F.col("tree") != PAGE), hosts, ["host"], "inner")
    share = F.when(F.col("tree").bitwiseAND(1) == 0, TREE_SHARE).otherwise(PIECE_SHARE)
    return cut(found.where(F.col("n") > share * F.col("n_pages")).groupBy("host").agg(F.collect_list("tree").alias("trees")))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> page_id, url, text, n_chars; one row per row.

    A null or empty html, or one without text, gives the empty string. A null url is a host of its own. Repeated rows
    count as one page for templates; a paragraph that recurs on more pages of a host than the limits say goes wherever it
    stands. Other columns are ignored; an empty table gives an empty result.
    """
    pages = pages.select("page_id", "url", "html")
    found = lookup(pages.withColumn("host", host_of(F.col("url"))), template_trees(pages), ["host"])
    return found.select("page_id", "url", page_text("html", "trees").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op7_html_extraction": op7_html_extraction}
ORACLES: dict[str, str] = {}
