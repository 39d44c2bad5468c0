"""Operator 9: main text of web pages, with the repeated runs of a host.

A page is read in one pass as blocks of text, each with the container it stands in. What elements or
their class, id and role name as menus, headers, footers, sidebars, notices, adverts, forms, comments
and the like is no text. The rest is decided over the whole host. The container that holds most distinct
text there is the host's body; all its blocks stay, as a repeated run can't tell a quoted passage or a
second copy of an article from boilerplate. Blocks elsewhere are asked: the token streams of the host's
distinct pages are put together in a suffix array, and blocks covered by runs of ``DEPTH`` tokens and
more that stand on ``PAGES`` distinct pages go; the unique ones stay. Elements that mark an article or
the main part only help: on pages that have such marks, blocks outside of both marks and body go.

A host with more than ``HOST_TOKENS`` asked tokens is dealt to many tasks by its runs, whose distinct
pages are counted by 128-bit hashes; that gives the same. So results don't depend on partitions.

A null page counts as empty; it has an empty text. A null url makes a host of its own. Repeated rows
are distinct pages only if their asked blocks differ. Tags left open at the page's end are dropped;
after a quote that is never closed, tags end at the next ``>``. Other columns are not read. An empty
table gives an empty one.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import blocks, save, shuffle_width, tune

#: Tokens of the shortest run that counts; distinct pages it must stand on; asked tokens of a host that a task holds.
DEPTH, PAGES, HOST_TOKENS = 8, 3, 1 << 20

#: Hosts whose bodies are small enough to go to every task (16 bytes each).
FEW_HOSTS = 1 << 19

#: What follows a tag's name, up to its end: quotes count after an equals sign. Nothing is read twice.
_REST = re.compile(r"(?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+>")
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*+")
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
#: Elements whose content is not markup.
RAW = {"script", "style", "textarea", "noembed", "xmp", "iframe", "noframes", "title"}
_RAW_ENDS = {t: re.compile(rf"</{t}\s*+>", re.I) for t in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that are no part of an article.
NOISE = {"nav", "footer", "aside", "form", "button", "select", "script", "style", "noscript", "template", "svg", "iframe", "dialog", "menu", "head", "textarea", "object", "canvas", "audio", "video", "title", "fieldset", "datalist", "noembed", "noframes", "xmp"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "input"}
#: Elements that give a text its form; they are no containers.
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "header", "hgroup", "address"}
#: Parts of class names, ids and roles that name what is no part of an article.
NAMES = set(
    "ad ads advert adverts advertisement advertisements adsense adbox banner promo promotion sponsor sponsored sponsors cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup "
    "share sharing social related recommended recommendations sidebar side menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager comment comments commentlist reply replies respond disqus discussion "
    "footer popup modal overlay toolbar widget widgets search login contentinfo complementary dialog form skip hidden masthead copyright legal disclaimer".split()
)
_P_ENDS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul", "li"}


class Block(NamedTuple):
    """A block's text, whether it is in a marked part, and its container's number."""

    text: str
    marked: bool
    container: int


def _attributes(attrs: str) -> dict[str, str]:
    return {name.lower(): "".join(values) for name, *values in _ATTR.findall(attrs)} if attrs and not attrs.isspace() else {}


def _parts(value: str) -> set[str]:
    return {p for p in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()) if p}


def _noise(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    """Whether an element is named as no part of an article; ``inside``: of a marked part."""
    if tag in NOISE or (tag == "header" and not inside):
        return True
    if not attrs or tag in ("body", "html"):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*+:\s*+none", attrs.get("style", "")):
        return True
    named = any(_parts(attrs[k]) & NAMES for k in ("class", "id", "role") if k in attrs)
    if tag in ("article", "main"):
        return any("comment" in attrs[k].lower() for k in ("class", "id", "role") if k in attrs)
    return named and not (tag in INLINE and tag not in ("a", "span"))


def _label(tag: str, attrs: dict[str, str]) -> str:
    """What tells containers of one host apart: names without digits."""
    return " ".join([tag, *(re.sub(r"\d+", "", attrs[k]) for k in ("class", "id") if k in attrs)])


class _Open(NamedTuple):
    tag: str
    noise: bool
    marked: bool
    container: int


class _Stack:
    """The open elements. Each question takes the same time however many are open."""

    def __init__(self) -> None:
        self.open: list[_Open] = []
        self.places: dict[str, list[int]] = {}
        self.whole: list[int] = []  # places of those that are not inline

    @property
    def top(self) -> _Open:
        return self.open[-1] if self.open else _Open("", False, False, 0)

    def push(self, x: _Open) -> None:
        self.places.setdefault(x.tag, []).append(len(self.open))
        if x.tag not in INLINE:
            self.whole.append(len(self.open))
        self.open.append(x)

    def cut(self, place: int) -> None:
        """Close the element at a place and all that are open in it."""
        while len(self.open) > place:
            x = self.open.pop()
            self.places[x.tag].pop()
            if x.tag not in INLINE:
                self.whole.pop()

    def last(self, tag: str) -> int:
        """Where the last such element is open; -1 if none is."""
        found = self.places.get(tag)
        return found[-1] if found else -1

    @property
    def last_whole(self) -> int:
        return self.whole[-1] if self.whole else -1


def page_blocks(page: str) -> list[Block]:
    """Blocks of a page that elements don't name as something else, in order. Time is in proportion to the page."""
    from xxhash import xxh64_intdigest

    found: list[Block] = []
    stack, parts = _Stack(), []
    n, at = len(page), 0
    quotes = True  # off after a quote that is never closed
    last_end, last_data = page.rfind(">"), page.rfind("]]>")

    def flush() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            top = stack.top
            found.append(Block(text, top.marked, top.container))

    def say(text: str) -> None:
        if not stack.top.noise:
            parts.append(entities.unescape(text) if "&" in text else text)

    def opened(tag: str, attrs: dict[str, str]) -> int:
        """Takes an opening tag and gives where reading goes on."""
        if tag == "br":
            say(" ")
        elif tag not in INLINE:
            flush()
        if tag in VOID:
            return at
        if tag in _P_ENDS and (k := stack.last_whole) >= 0 and stack.open[k].tag in (("p", "li") if tag == "li" else ("p",)):
            stack.cut(k)  # a block ends an open paragraph and what is open inside it
        own = _noise(tag, attrs, stack.top.marked)
        if tag in ("article", "main") and not own and stack.last("article") < 0 and stack.last("main") < 0:
            while stack.top.noise:  # an element before the article was not closed
                stack.cut(len(stack.open) - 1)
        up = stack.top
        if own and not up.noise:
            flush()
        if tag in RAW:
            end = _RAW_ENDS[tag].search(page, at)
            return end.end() if end else n
        container = up.container if tag in INLINE or tag in PROSE else xxh64_intdigest(f"{up.container} {_label(tag, attrs)}".encode("utf-8", "replace")) - (1 << 63)
        stack.push(_Open(tag, up.noise or own, up.marked or tag in ("article", "main") or attrs.get("role", "").lower() == "main", container))
        return at

    def closed(tag: str) -> None:
        k = stack.last(tag)
        if tag in INLINE:
            if k > stack.last_whole:
                if stack.open[k].noise != (stack.open[k - 1].noise if k else False):
                    flush()
                stack.cut(k)
        else:
            flush()
            if k >= 0:
                stack.cut(k)

    while at < n:
        start = page.find("<", at)
        if start < 0:
            start = n
        if start > at:
            say(page[at:start])
        at = start + 1
        if start == n:
            break
        if page.startswith("!--", at):
            end = page.find("-->", at + 1)
            at = end + 3 if end >= 0 else n
        elif page.startswith("![CDATA[", at) and last_data > at:
            end = page.find("]]>", at)
            if not stack.top.noise:
                parts.append(page[at + 8 : end])
            at = end + 3
        elif page[at : at + 1] in ("!", "?") and last_end > at:
            at = page.find(">", at) + 1
        elif (name := _NAME.match(page, at)) and last_end >= name.end():
            rest = _REST.match(page, name.end()) if quotes else None
            if rest is None:
                quotes = False
            end = rest.end() if rest else page.find(">", name.end()) + 1
            attrs, at, tag = page[name.end() : end - 1], end, name[0].lower()
            if tag[0] == "/":
                closed(tag[1:])
            else:
                at = opened(tag, _attributes(attrs))
        elif name:  # a tag that the page's end cuts off
            at = n
        else:
            say("<")
    flush()
    return found


def suffix_ranks(tokens: np.ndarray, page: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Rank of each suffix by its first ``depth`` tokens (a power of two), equal ones alike; no run goes past its page's end."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    span = 1
    while span < depth:
        after = np.zeros(n, np.int64)
        same = page[span:] == page[:-span] if n > span else np.zeros(0, bool)
        after[: n - span] = np.where(same, rank[span:], 0) if n > span else 0
        rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
        span *= 2
    return rank


def covered(pages: list[list[str]], depth: int = DEPTH, least: int = PAGES) -> list[list[bool]]:
    """For each block of a host's pages, whether runs that stand on several distinct pages cover all its tokens. Equal pages count as one."""
    distinct: dict[tuple[str, ...], int] = {}
    of = [distinct.setdefault(tuple(p), len(distinct)) for p in pages]
    vocabulary: dict[str, int] = {}
    ids: list[int] = []
    owner: list[int] = []
    places: list[list[tuple[int, int]]] = []
    for k, blocks_ in enumerate(distinct):
        places.append([])
        for b in blocks_:
            words = b.split(" ")
            places[-1].append((len(ids), len(ids) + len(words)))
            ids.extend(vocabulary.setdefault(w, len(vocabulary)) for w in words)
            owner.extend([k] * len(words))
    if not ids:
        return [[False] * len(p) for p in pages]
    tokens, page = np.array(ids, np.int64), np.array(owner, np.int64)
    rank = suffix_ranks(tokens, page, depth)
    n = len(tokens)
    whole = np.zeros(n, bool)
    whole[: max(0, n - depth + 1)] = page[depth - 1 :] == page[: n - depth + 1] if n >= depth else False
    order = np.lexsort((page, rank))
    first = np.concatenate([[True], (rank[order][1:] != rank[order][:-1]) | (page[order][1:] != page[order][:-1])])
    on_pages = np.bincount(rank[order][first], minlength=rank.max() + 1)
    starts = np.flatnonzero((on_pages[rank] >= least) & whole)
    found = []
    bare = _bare(n, starts, depth)
    for p in places:
        found.append([bool(bare[b] == bare[a]) for a, b in p])
    return [found[k] for k in of]


def _bare(n: int, starts: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """How many tokens before each place no run covers."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + depth, -1)
    return np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) == 0)])


def _text(own: list[str], asked: list[bool], gone: list[bool]) -> str:
    """The blocks but those that were asked and are gone."""
    answers = iter(gone)
    return "\n\n".join(b for b, a in zip(own, asked, strict=True) if not (a and next(answers)))


def _asked(own: list[str], asked: list[bool]) -> list[str]:
    return [b for b, a in zip(own, asked, strict=True) if a]


Batches = Iterator[pa.RecordBatch]


def _hosts(batches: Batches) -> Batches:
    """Rows (page_id, url, blocks, asked, host) sorted by host. Gives the pages' texts, a host at a time."""
    held: list[tuple] = []

    def close() -> Batches:
        gone = covered([_asked(own, asked) for _, _, own, asked, _ in held])
        for k in range(0, len(held), 256):
            some = held[k : k + 256]
            texts = [_text(own, asked, g) for (_, _, own, asked, _), g in zip(some, gone[k : k + 256], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], kind), pa.array([r[1] for r in some], pa.string()), pa.array(texts, pa.string())], names=["page_id", "url", "text"])
        held.clear()

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if held and held[-1][4] != row[4]:
                yield from close()
            held.append(row)
    if held:
        yield from close()


def _runs(batches: Batches) -> Batches:
    """Rows (page, host, asked blocks). Gives each run of a page once, hashed with the host, and where it starts."""
    from xxhash import xxh128_digest

    for batch in batches:
        for page, host, own in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            words = " ".join(own).encode().split(b" ")
            places: dict[bytes, list[int]] = {}
            name = host.encode() + b"\n"
            for k in range(len(words) - DEPTH + 1):
                places.setdefault(xxh128_digest(name + b" ".join(words[k : k + DEPTH])), []).append(k)
            if places:
                yield pa.RecordBatch.from_arrays([pa.array([page] * len(places)), pa.array(list(places), pa.binary()), pa.array(list(places.values()), pa.list_(pa.int32()))], names=["page", "run", "starts"])


def _hot(batches: Batches) -> Batches:
    """Rows (page_id, url, blocks, asked, starts of repeated runs). Gives the pages' texts."""
    for batch in batches:
        texts = []
        for own, asked, starts in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
            some = _asked(own, asked)
            ends = np.cumsum([b.count(" ") + 1 for b in some], dtype=np.int64)
            bare = _bare(int(ends[-1]) if len(some) else 0, np.array(starts or [], np.int64))
            texts.append(_text(own, asked, [bool(bare[e] == bare[e - b.count(" ") - 1]) for e, b in zip(ends.tolist(), some, strict=True)]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text (blocks joined by an empty line), n_chars."""
    spark = df.sparkSession
    tune(spark)
    pages = df.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    id_kind = pages.schema["page_id"].dataType.simpleString()

    def read(batches: Batches) -> Batches:
        for block in blocks(batches, "html"):
            made = [page_blocks(h or "") for h in block.column(2).to_pylist()]
            columns = [pa.array([[b[k] for b in m] for m in made], pa.list_(kind)) for k, kind in enumerate((pa.string(), pa.bool_(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), *columns], names=["page_id", "url", "texts", "marks", "containers"])

    parsed = save(pages.mapInArrow(read, f"page_id {id_kind}, url string, texts array<string>, marks array<boolean>, containers array<long>"), "pages")
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    named = parsed.withColumn("host", host)
    each = named.select(F.xxhash64("host").alias("h"), F.inline(F.arrays_zip("texts", "containers")))
    texts = each.groupBy("h", "containers", F.xxhash64("texts").alias("text")).agg(F.max(F.char_length("texts")).alias("n"))
    sizes = texts.groupBy("h", "containers").agg(F.sum("n").alias("n"))
    body = save(sizes.groupBy("h").agg(F.max(F.struct("n", "containers"))["containers"].alias("body")), "bodies")
    if body.count() <= FEW_HOSTS:  # else pages and bodies meet by the host
        body = F.broadcast(body)
    # a block stays in question or for good: in the body, in a marked part, or on a page without marks
    has_marks = F.exists("marks", lambda m: m)
    zipped = F.filter(F.arrays_zip("texts", "marks", "containers"), lambda b: (b["containers"] == F.col("body")) | b["marks"] | ~F.col("has_marks"))
    told = named.withColumn("has_marks", has_marks).join(body, F.xxhash64("host") == F.col("h"), "left").select("page_id", "url", "host", "body", zipped.alias("b"))
    told = told.select("page_id", "url", "host", F.col("b.texts").alias("blocks"), F.transform("b.containers", lambda c: c != F.col("body")).alias("asked"))
    some = F.exists("asked", lambda a: a)
    out = told.where(~some).select("page_id", "url", F.array_join("blocks", "\n\n").alias("text"))
    asked = told.where(some)
    if not asked.isEmpty():
        own = F.transform(F.filter(F.arrays_zip("blocks", "asked"), lambda b: b["asked"]), lambda b: b["blocks"])
        tokens = F.aggregate(own, F.lit(0).cast("long"), lambda n, b: n + F.size(F.split(b, " ")))
        large = save(asked.groupBy("host").agg(F.sum(tokens).alias("n")).where(F.col("n") > HOST_TOKENS).select("host"), "hot-hosts")
        schema = f"page_id {id_kind}, url string, text string"
        small = asked.join(large, "host", "left_anti").select("page_id", "url", "blocks", "asked", "host")
        out = out.union(small.repartition(shuffle_width(spark), "host").sortWithinPartitions("host").mapInArrow(_hosts, schema))
        if not large.isEmpty():
            hot = asked.join(large, "host", "left_semi").withColumn("own", own).withColumn("page", F.md5(F.concat_ws("\n", "host", "own")))  # blocks hold no line ends
            distinct = hot.groupBy("page").agg(F.first("host").alias("host"), F.first("own").alias("own"))
            runs = save(distinct.select("page", "host", "own").mapInArrow(_runs, "page string, run binary, starts array<int>"), "runs")
            repeated = runs.groupBy("run").count().where(F.col("count") >= PAGES).select("run")
            starts = runs.join(repeated, "run", "left_semi").groupBy("page").agg(F.flatten(F.collect_list("starts")).alias("starts"))
            out = out.union(hot.join(starts, "page", "left").select("page_id", "url", "blocks", "asked", "starts").mapInArrow(_hot, schema))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
