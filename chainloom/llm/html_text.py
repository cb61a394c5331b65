"""Main text of web pages: markup, and substrings that repeat across the pages of a host.

A page is read into blocks. Markup rules out what it marks as menu, header, footer, sidebar, notice, advert, form or
reader comment, and says which blocks lie in an article, or else in main. The rest is decided by what the host's other
pages hold: all suffixes of a host's token streams are named by their first REPEATED tokens, by prefix doubling
(names of 1, 2, 4, ... tokens are put together from names of half the length), and a name that stands on distinct pages
marks a substring that repeats. Names are 64-bit hashes, so equal prefixes of a host meet in one aggregate over all
its pages, however many there are, and no result depends on partitions.

* A page with neither an article nor main loses every token that a repeated substring covers; its unique runs stay. A
  page without a unique run of REPEATED tokens copies other pages; it loses only substrings that stand on twice as
  many pages as the middle one of its own.
* A block inside an article goes if it stands, whole, in nearly all distinct articles of its host (ARTICLE_SHARE of at
  least ARTICLES). Passages that some articles share are text: articles quote and copy each other.

Only names travel to be counted, and only those that decide something travel back, as lists by page. Memory is bounded
by one page; a host with a third of all pages is no hot key, as rows are dealt by name and aggregated before.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import settle, small_batches

REPEATED = 8
ARTICLE_SHARE = 0.9
ARTICLES = 10

#: Elements whose content is never text of the article (fixed values of the HTML vocabulary).
DROPPED = frozenset(
    "head script style noscript template nav footer aside form button select textarea option datalist iframe object embed "
    "svg canvas math dialog menu audio video map title".split()
)
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
#: An open element of these ends where the next one of the same kind begins.
SELF_ENDING = frozenset("p li dt dd tr td th option".split())
#: Blocks whose start ends an open paragraph, and elements that a paragraph outside of them doesn't end in.
ENDS_P = BLOCKS - frozenset("br caption head html body legend tbody thead tfoot title".split())
HOLDS_P = frozenset("button td th caption object".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
#: Names in a class, id or role that mark what isn't the article.
MARKS = frozenset(
    "ad ads adbox advert advertisement adverts banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "notices popup modal overlay sidebar sidebars menu menus nav navbar navigation navi breadcrumb breadcrumbs header "
    "masthead footer contentinfo complementary comment comments commentlist respond disqus reply replies share sharing "
    "social related recommended newsletter subscribe subscription widget widgets toolbar pagination pager skip search "
    "searchbox login signup copyright disclaimer alert dialog tags".split()
)
#: Marks that inside an article are as likely its own text.
ALSO_TEXT = frozenset("header tags alert dialog disclaimer".split())
#: Words beside them that change nothing: "site-footer" and "comment-list" are marks, "notice-board" is none.
BESIDE = frozenset(
    "site page main global top bottom left right inner outer primary secondary list item items box container wrapper wrap "
    "area section block bar body content form link links button buttons icon icons unit slot panel title post posts "
    "article articles fixed sticky mobile desktop small large row col group".split()
)
_MARKUP = re.compile(r"<(?=[a-zA-Z/!?])")
_NAME = re.compile(r"[a-zA-Z][^\s/><]*+")
_ATTRIBUTES = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?+""")
_CLOSE = {tag: re.compile(rf"</{tag}[\s/>]", re.I) for tag in RAW}
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", re.I)
_LONG_REFERENCE = re.compile(r"&#(?:[0-9]{9,}|[xX][0-9a-fA-F]{9,});?")


@dataclass
class Block:
    """One block: its text, and whether markup puts it inside the article or main, or rules it out."""

    text: str
    where: str  # "article", "main", "plain" or "out"


@dataclass
class _Open:
    tag: str
    where: str


@dataclass
class _Reader:
    blocks: list[Block] = field(default_factory=list)
    parts: list[tuple[str, str]] = field(default_factory=list)  # of the open block: text, and where it stands
    linked: int = 0
    stack: list[_Open] = field(default_factory=list)
    open_: Counter = field(default_factory=Counter)
    in_link: int = 0

    @property
    def where(self) -> str:
        return self.stack[-1].where if self.stack else "plain"

    def text(self, piece: str) -> None:
        if "&#" in piece:
            piece = _LONG_REFERENCE.sub("�", piece)  # no such character
        piece = html.unescape(piece)
        self.parts.append((piece, self.where))
        self.linked += len(piece) if self.in_link and self.where != "out" else 0

    def flush(self) -> None:
        """Close the open block. What an inline element rules out is cut from it without a space."""
        if not self.parts:
            return
        kept = [x for x in self.parts if x[1] != "out"]
        raw = "".join(x for x, _ in kept)
        if text := " ".join(raw.split()):
            where = kept[0][1]
            if where == "plain" and self.linked == len(raw) and self.open_["li"]:
                where = "out"  # an entry of a list that is all link: a menu
            self.blocks.append(Block(text, where))
        if len(kept) < len(self.parts) and (text := " ".join("".join(x for x, w in self.parts if w == "out").split())):
            self.blocks.append(Block(text, "out"))
        self.parts, self.linked = [], 0

    def end_paragraph(self) -> None:
        """End the paragraph that a block begins in, if any; what it has of open formatting goes on behind it."""
        again: list[_Open] = []
        for o in reversed(self.stack):
            if o.tag == "p":
                self.close("p")
                for x in reversed(again):
                    self.push(x.tag, x.where)
                return
            if o.tag in FORMATTING:
                again.append(o)
            if o.tag in HOLDS_P or o.tag in BLOCKS:
                return

    def push(self, tag: str, where: str) -> None:
        self.stack.append(_Open(tag, where))
        self.open_[tag] += 1

    def close(self, tag: str) -> None:
        """Close the innermost open element of this name and all inside it."""
        while self.open_[tag]:
            gone = self.stack.pop().tag
            self.open_[gone] -= 1
            if gone == tag:
                return


def is_mark(name: str) -> bool:
    """Whether a class, id or role marks what isn't the article.

    >>> [is_mark(x) for x in ("notice", "site-footer", "commentList", "ad_2", "notice-board", "related-work", "roadmap")]
    [True, True, True, True, False, False, False]
    """
    if name.lower() in MARKS:
        return True
    parts = [w.lower() for w in _PARTS.findall(name)]
    return any(w in MARKS for w in parts) and all(w in MARKS or w in BESIDE for w in parts)


def _marked(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element's own attributes rule it out."""
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
            return True
        if name == "style":
            if _HIDDEN.search(value):
                return True
        elif name == "role" or name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            for token in value.split():
                if is_mark(token) and not (inside and token.lower() in ALSO_TEXT):  # an article's own header holds its heading
                    return True
    return False


def _tags(page: str) -> Iterator[tuple[str, str, str]]:
    """What a page is made of, in one pass: ("", text, ""), ("<", name, attributes) and ("/", name, ""); comments,
    declarations and raw elements are left out. Each character is looked at a bounded number of times: a search that
    has run to the end of the page without success isn't tried again.
    """
    at, n = 0, len(page)
    quotes = True  # until a tag's quotes turn out never to close
    last_end = page.rfind(">")
    while at < n:
        markup = _MARKUP.search(page, at)
        if markup is None:
            yield "", page[at:], ""
            return
        lt = markup.start()
        if lt > last_end and page[lt + 1] not in "!?":  # no tag ends any more; what the end of the page cuts off goes
            cut = page.rfind("<", lt)
            yield "", page[at : cut if _NAME.match(page, cut + 1) else n], ""
            return
        if lt > at:
            yield "", page[at:lt], ""
        after = page[lt + 1 : lt + 4]
        if after.startswith("!--"):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if after[:1] in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        slash = after[:1] == "/"
        name = _NAME.match(page, lt + 1 + slash)
        if name is None:
            yield "", "<", ""
            at = lt + 1
            continue
        rest = _ATTRIBUTES.match(page, name.end()) if quotes else None
        if rest is None:
            quotes = False
            end = page.find(">", name.end()) + 1
        else:
            end = rest.end()
        tag = name.group().lower()
        yield "/" if slash else "<", tag, "" if slash else page[name.end() : end - 1]
        at = end
        if tag in RAW and not slash:
            close = _CLOSE[tag].search(page, at)
            at = n if close is None else page.find(">", close.start()) + 1 or n


def read_blocks(page: str, by_class: bool = True) -> list[Block]:
    """The blocks of a page in order.

    >>> [(b.text, b.where) for b in read_blocks("<nav><a>x</a></nav><article><h1>A&amp;B</h1><p>c <b>d</b>e<p>f</article>")]
    [('x', 'out'), ('A&B', 'article'), ('c de', 'article'), ('f', 'article')]
    """
    r = _Reader()
    for kind, tag, attributes in _tags(page):
        if not kind:
            r.text(tag)
            continue
        if tag in BLOCKS:
            r.flush()
        if kind == "/":
            if tag == "a":
                r.in_link = max(0, r.in_link - 1)
            r.close(tag)
            continue
        if tag == "body":
            r.close("head")
        if tag in RAW or tag in VOID or attributes.endswith("/"):
            continue
        if tag in ENDS_P and r.open_["p"]:
            r.end_paragraph()
        if tag in SELF_ENDING and r.stack and r.stack[-1].tag == tag:
            r.close(tag)
        if tag == "a":
            r.in_link += 1
        where = r.where
        if where != "out":
            inside = where in ("article", "main")
            if tag in DROPPED or tag == "header" and not inside or by_class and attributes and _marked(tag, attributes, inside):
                where = "out"
            elif tag == "article":
                where = "article"
            elif tag == "main" and where == "plain":
                where = "main"
        if tag in BLOCKS or where != r.where or tag in DROPPED or r.open_[tag]:
            r.push(tag, where)
    r.flush()
    return r.blocks


def judged(page: str) -> tuple[list[Block], str]:
    """Blocks, and what markup knows: "article", "main" (with the articles in it), or "plain" where it has neither. Where a
    page has both, articles that hold less text than the rest of main are teasers in it."""
    blocks = read_blocks(page)
    kinds = {b.where for b in blocks}
    if blocks and kinds == {"out"}:  # every block was ruled out: some outer element's class misled
        blocks = read_blocks(page, False)
        kinds = {b.where for b in blocks}
    size = {k: sum(len(b.text) for b in blocks if b.where == k) for k in ("article", "main")}
    if size["main"] > size["article"]:
        return blocks, "main"
    return blocks, next((k for k in ("article", "main") if k in kinds), "plain")


def suffix_names(tokens: np.ndarray, least: int) -> np.ndarray:
    """Names of the suffixes that have ``least`` tokens, by these tokens: prefix doubling over hashes of tokens.

    >>> a = suffix_names(np.array([1, 2, 3, 1, 2, 3], np.uint64), 3)
    >>> len(a), bool(a[0] == a[3]), len(set(a.tolist()))
    (4, True, 3)
    """
    names, have = tokens, 1
    while have < least:
        step = min(have, least - have)
        names = _mixed((names[: len(names) - step] * np.uint64(0x9E3779B97F4A7C15)) ^ names[step:]) if len(names) > step else names[:0]
        have += step
    return names


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash(text: str, seed: int = 0) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed)


def stream_names(blocks: list[Block], host: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the suffixes of a run of blocks, and its tokens' hashes; the host is part of a name."""
    words = [w for b in blocks for w in b.text.split(" ")]
    known = {w: _hash(w) for w in set(words)}
    tokens = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    return _mixed(suffix_names(tokens, least) ^ np.uint64(host)), tokens


def block_name(text: str, host: int) -> int:
    return _hash(text, host)


def page_names(blocks: list[Block], kind: str, host: int, least: int) -> tuple[set[int], set[int], int]:
    """Names outside of the article, names of whole blocks inside it, and a name of what the page says."""
    inside = [b for b in blocks if b.where == "article" or kind == "main" and b.where == "main"] if kind != "plain" else []
    whole = {block_name(b.text, host) for b in inside if b.text.count(" ") >= least - 1}
    says = _hash("\n".join(b.text for b in (inside or blocks)))
    names: set[int] = set()
    run: list[Block] = []
    held = set(map(id, inside))
    for b in [*blocks, None]:
        if b is not None and id(b) not in held:
            run.append(b)
        elif run:
            names.update(stream_names(run, host, least)[0].tolist())
            run = []
    return names, whole, says


def unique_runs(tokens: list[str], covered: np.ndarray, least: int) -> list[str]:
    """A block's tokens without covered runs. A repeated substring may reach a few tokens into the next block, where
    pages only happen to begin alike; so a shorter run goes only if it is the whole block.

    >>> unique_runs(list("abcd"), np.array([True, False, True, True]), 2)
    ['a', 'b']
    """
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    gone = np.zeros(len(tokens), bool)
    for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        gone[lo:hi] = hi - lo >= least or hi - lo == len(tokens)
    return [t for t, g in zip(tokens, gone.tolist(), strict=True) if not g]


def plain_text(blocks: list[Block], host: int, counts: dict[int, int], least: int) -> tuple[str, int]:
    """Text of a page without an article, given on how many pages its repeated names stand, and how many tokens went."""
    names, tokens = stream_names(blocks, host, least)
    pages = np.array([counts.get(x, 1) for x in names.tolist()], np.int64)

    def left(most: float) -> list[tuple[list[str], list[str]]]:
        edges = np.zeros(len(tokens) + 1, np.int64)
        starts = np.flatnonzero(pages >= most)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + least, -1)
        covered, at, out = np.cumsum(edges[:-1]) > 0, 0, []
        for b in blocks:
            words = b.text.split(" ")
            if b.where != "out":
                out.append((words, unique_runs(words, covered[at : at + len(words)], least)))
            at += len(words)
        return out

    kept = left(2)
    if len(names) and max((len(run) for _, run in kept), default=0) < least:
        kept = left(2 * float(np.median(pages)))  # a copy: what most of it has in common with its like is its text
    return " ".join(w for _, run in kept for w in run), sum(len(words) - len(run) for words, run in kept)


#: Kinds of names: of a substring, of a block of an article, of a host itself.
SUBSTRING, BLOCK, HOST = 0, 1, 2


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    least: int = REPEATED, share: float = ARTICLE_SHARE, articles: int = ARTICLES,
) -> DataFrame:
    """One row per page: ``id_col``, ``url_col``, text, n_chars (code points), n_repeated (tokens that went because other
    pages of the host hold them).

    Edge cases: null or empty html has an empty text. Broken markup is read in linear time: a quote that never closes is
    no quote, a tag that the end of the page cuts off goes, any other stray "<" is text. A null or odd url belongs to the
    host "". Repeated rows give a row each; pages that say the same count as one page, so copies don't make each other
    boilerplate. Very long pages are read whole, a page at a time. An empty table gives no rows. Only the three columns
    are read, so names of others don't matter.
    """
    url = F.col(url_col).cast("string")
    host = F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"), host.alias("host"))
    rows = rows.select("id", "url", "html", "host", F.xxhash64("id", "url", "html").alias("key"))  # equal rows are one page
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def read(batches) -> Iterator:
        import pyarrow as pa
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            hosts, blobs, hashes, says_, names_, kinds_ = [], [], [], [], [], []
            for page, name in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                blocks, kind = judged(page)
                at = _hash(name)
                outside, whole, says = page_names(blocks, kind, at, least)
                kept = blocks if kind == "plain" else [b for b in blocks if b.where == "article" or b.where == kind]
                blobs.append(packer.compress("\n".join([kind, *(b.where[0] + b.text for b in kept)]).encode("utf-8", "surrogatepass")))
                every = [*outside, *whole, *([at] if whole else [])]
                hosts.append(at), says_.append(says)
                names_.append(np.array(every, np.uint64).view(np.int64))
                kinds_.append(bytes([SUBSTRING] * len(outside) + [BLOCK] * len(whole) + [HOST] * bool(whole)))
                hashes.append(kind == "plain")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), batch.column(4), pa.array(np.array(hosts, np.uint64).view(np.int64)), pa.array(blobs, pa.binary()),
                    pa.array(hashes, pa.bool_()), pa.array((np.array(says_, np.uint64) >> np.uint64(33)).astype(np.int32)),
                    pa.array(names_, pa.list_(pa.int64())), pa.array([np.frombuffer(k, np.int8) for k in kinds_], pa.list_(pa.int8())),
                ],
                names=["id", "url", "key", "host", "blob", "plain", "says", "names", "kinds"],
            )

    schema = f"id {types['id']}, url {types['url']}, key bigint, host bigint, blob binary, plain boolean, says int, names array<bigint>, kinds array<tinyint>"
    with small_batches(pages.sparkSession):
        parsed = settle(rows.mapInArrow(read, schema))
    each = parsed.select("key", "host", "plain", "says", F.explode(F.arrays_zip("names", "kinds")).alias("x"))
    each = each.select("key", "host", "plain", "says", F.col("x.names").alias("name"), F.col("x.kinds").alias("kind"))
    counts = each.groupBy("name").agg(F.count_distinct("says").alias("n"), F.max("kind").alias("kind"), F.max("host").alias("host")).filter("n > 1")
    counts = settle(counts)
    hosts = counts.filter(f"kind = {HOST} AND n >= {int(articles)}").select(F.col("name").alias("of"), F.col("n").alias("all"))
    common = counts.filter(f"kind = {BLOCK} AND n >= {int(articles)} * {float(share)}").join(hosts, F.col("host") == F.col("of"))
    common = common.filter(F.col("n") >= F.lit(float(share)) * F.col("all")).select("name", "n")
    telling = settle(counts.filter(f"kind = {SUBSTRING}").select("name", "n").union(common))
    # What a page itself can lose: substrings where it has no article, else whole blocks. A list is bounded by its page.
    own = each.filter(f"kind = CASE WHEN plain THEN {SUBSTRING} ELSE {BLOCK} END").select("key", "name").distinct()
    marks = own.join(telling, "name").groupBy("key").agg(F.collect_list(F.struct("name", "n")).alias("marks"))
    marks = settle(marks.withColumnRenamed("key", "marked"))

    def build(batches) -> Iterator:
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts, gone = [], []
                for blob, at, marked in zip(part.column(2).to_pylist(), part.column(3).to_numpy(zero_copy_only=False).view(np.uint64).tolist(), part.column(4).to_pylist(), strict=True):
                    kind, *lines = unpack.decompress(blob).decode("utf-8", "surrogatepass").split("\n")
                    found = {x["name"] % (1 << 64): x["n"] for x in marked or ()}
                    if kind == "plain":
                        text, n = plain_text([Block(x[1:], "out" if x[0] == "o" else "plain") for x in lines], at, found, least)
                    else:
                        kept = [x[1:] for x in lines if not found or block_name(x[1:], at) not in found]
                        text, n = " ".join(kept), sum(x.count(" ") + 1 for x in lines) - sum(x.count(" ") + 1 for x in kept)
                    texts.append(text.encode("utf-8", "replace").decode()), gone.append(n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(gone, pa.int64())],
                    names=["id", "url", "text", "n_chars", "n_repeated"],
                )

    # Marks are a table in the shared folder, so Spark knows their size: it broadcasts small ones and shuffles others.
    out = parsed.select("id", "url", "blob", "host", "key").join(marks, F.col("key") == F.col("marked"), "left").select("id", "url", "blob", "host", "marks")
    out = out.mapInArrow(build, f"id {types['id']}, url {types['url']}, text string, n_chars bigint, n_repeated bigint")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars", "n_repeated")
