"""Main-text extraction: a tolerant block parser, and a site style tree that finds the branches a site repeats."""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, small

#: A branch is removed below this importance, judged on at least so many different pages of its host.
LEAST_IMPORTANCE, LEAST_PAGES = 0.2, 5
_GAMMA = 0.9

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.S)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
_SKIP = frozenset(
    "head script style noscript template iframe nav footer aside form button select option textarea input dialog menu svg canvas object audio video title noembed noframes".split()
)
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - frozenset("td th tr tbody thead tfoot caption html head body".split())
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table select body html article section div".split())
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|adsense|sponsor|sponsored|promo|promotion|banner|cookie|cookies|consent|gdpr|notice|notices|"
    r"alert|sidebar|side-bar|widget|widgets|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|footer|header|masthead|topbar|toolbar|comment|comments|"
    r"disqus|reply|replies|respond|social|share|sharing|related|recommended|newsletter|subscribe|signup|popup|modal|overlay|pagination|pager|"
    r"skip|login|search|tags|tagcloud|copyright|legal|disclaimer|hidden)(?:$|[\s_-])",
    re.I,
)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar alertdialog".split())
_DIGITS = re.compile(r"\d+")
_VALUES = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", re.S)
#: Levels whose names a path spells out; below them it ends in a hash of the further names.
_SPELLED = 60


class Block:
    """A run of text: where it stands (path of tags with class and id), whether a skipped element holds it, whether an
    article does, and the path inside the article."""

    __slots__ = ("path", "text", "skipped", "main", "plain")

    def __init__(self, path, text, skipped, main, plain):
        self.path, self.text, self.skipped, self.main, self.plain = path, text, skipped, main, plain


class Children:
    """What a node's children are in order: a running hash, in which repeats of one child in a row count once."""

    __slots__ = ("last", "hash")

    def __init__(self):
        self.last, self.hash = None, hashlib.blake2b(digest_size=8)

    def add(self, name: str) -> None:
        if name != self.last:
            self.last = name
            self.hash.update(name.encode() + b"|")

    def feature(self) -> int:
        return int.from_bytes(self.hash.digest(), "little", signed=True)


def _below(above: str, own: str, depth: int) -> str:
    """The path of a child. Deep nodes keep a hash of the names below the spelled levels, so that they stay apart."""
    if depth < _SPELLED:
        return f"{above}/{own}"
    spelled, _, tail = above.partition("/~")
    return f"{spelled}/~{_hash(f'{tail}/{own}') & 0xFFFFFFFFFFFFFFFF:016x}"


def parse_blocks(page: str) -> tuple[list[Block], dict[str, Children]]:
    """The text blocks of a page in order, and the children seen under every path."""
    blocks: list[Block] = []
    children: dict[str, Children] = {}
    # open elements: (tag, path, skipped, in main, plain since main)
    stack: list[tuple[str, str, bool, bool, bool]] = [("", "", False, False, True)]
    held: list[str] = []

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                _, path, skipped, main, plain = owner[0]
                blocks.append(Block(path, text, skipped, main, plain))

    owner = [stack[0]]

    def put(text: str) -> None:
        if text:
            top = stack[-1]
            if not held:
                owner[0] = top
            elif top[2] != owner[0][2] and text.strip():  # text of a skipped inline element stays apart
                flush()
                owner[0] = top
            held.append(text)

    def close(until: int) -> None:
        while len(stack) > until:
            if stack[-1][0] in _BLOCK or stack[-1][2]:
                flush()
            stack.pop()

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            put(page[at:])
            break
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None or not m.group(4):  # a comment, declaration, or a tag that the page's end cuts off
            continue
        tag = tag.lower()
        if m.group(1):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
            else:
                if tag in _BLOCK:
                    flush()
            if tag in _BLOCK:
                flush()
            continue
        if tag in _BLOCK:
            flush()
            if tag in _CLOSES_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p":
                        close(i)
                        break
                    if stack[i][0] in _SCOPE:
                        break
        if tag in _SIBLINGS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in _SIBLINGS[tag]:
                    close(i)
                    break
                if stack[i][0] in _SCOPE:
                    break
        if tag in _VOID:
            if tag in ("br", "hr"):
                put(" ")
            continue
        _, above, skipped, main, plain = stack[-1]
        own, marks = tag, ""
        attrs = m.group(3)
        if attrs and "=" in attrs:
            found = {k.lower(): a or b or c or "" for k, a, b, c in _ATTR.findall(attrs)}
            marks = f"{found.get('class', '')} {found.get('id', '')}".strip()
            if marks:
                own += "." + _DIGITS.sub("0", ".".join(marks.split())).replace("/", "|")
            role = found.get("role", "").lower()
            if tag not in ("html", "body") and (_NAMES.search(marks) or role in _ROLES) and not (tag in ("article", "main") and not main):
                skipped = True
            if role == "main":
                main, plain = True, True
        if attrs and "hidden" in attrs.lower() and "hidden" in _VALUES.sub(" ", attrs.lower()).split():
            skipped = True
        if tag in _SKIP or (tag == "header" and not main):
            skipped = True
        path = _below(above, own, len(stack))
        if above not in children:
            children[above] = Children()
        children[above].add(own)
        if tag in ("article", "main"):
            main, plain = True, True
        elif main and marks:
            plain = False
        if tag in _RAW:
            stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = stop.end() if stop else end
            if tag in _BLOCK:
                flush()
            continue
        if skipped and not stack[-1][2]:
            flush()
        stack.append((tag, path, skipped, main, plain))
    flush()
    return blocks, children


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per page, once each: its content nodes with their text, and its inner nodes with their children in order."""
    for df in batches:
        rows: list[tuple] = []
        for host, page in zip(df["host"], df["html"], strict=True):
            blocks, children = parse_blocks(page)
            mark = _hash("\n".join(b.text for b in blocks if not b.skipped))
            seen = {(b.path, True, _hash(b.text)) for b in blocks}
            # a list of three items is presented like one of nine
            seen |= {(path, False, kids.feature()) for path, kids in children.items()}
            rows += [(host, mark, *x) for x in seen]
        yield pd.DataFrame(rows, columns=["host", "page", "path", "content", "feature"])


def _tree(df: pd.DataFrame) -> pd.DataFrame:
    """One site: composite importance of every node, from the leaves up; returns the low ones. Nodes are those of two
    pages at least; ``pinned`` ones have a child on one page only, which is of importance 1, and so are they."""
    own: dict[str, float] = {}
    shown: dict[str, float] = {}
    pages: dict[str, int] = {}
    pinned: set[str] = set()
    for path, content, inner, m, pin in df[["path", "own", "shown", "m", "pinned"]].itertuples(index=False):
        pages[path] = int(m)
        if content == content:
            own[path] = content
        if inner == inner:
            shown[path] = inner
        if pin:
            pinned.add(path)
    below: dict[str, list[str]] = {}
    for path in pages:
        if path:
            below.setdefault(path.rpartition("/")[0], []).append(path)
    whole: dict[str, float] = {}
    for path in sorted(pages, key=lambda p: -p.count("/")):
        kids = [whole[k] for k in below.get(path, ()) if k in whole]
        parts = []
        if path in own:
            parts.append(own[path])
        if kids:
            keep = _GAMMA ** len(kids)
            parts.append((1 - keep) * shown.get(path, 0.0) + keep * (sum(kids) / len(kids)))
            parts[-1] = max(parts[-1], max(kids))  # a branch is not removed above an important child
        whole[path] = 1.0 if path in pinned else max(parts) if parts else shown.get(path, 1.0)
    low = [p for p, v in whole.items() if p and v < LEAST_IMPORTANCE and pages[p] >= LEAST_PAGES]
    return pd.DataFrame({"host": df["host"].iloc[0], "paths": [sorted(low)]}) if low else pd.DataFrame({"host": [], "paths": []}, dtype=object)


def site_style(pages: DataFrame) -> DataFrame:
    """pages (host, html) -> (host, paths): branches of low importance per host.

    Content nodes: 1 minus the mean, over their texts, of log(pages that show the text) / log(pages that have the
    node). Inner nodes: entropy of their child sequences to the base of their pages, blended with their children.
    Pages of equal text count once, so copies of one page do not make its text look like a template. Nodes of one page
    are settled before a host is put together: a task holds the paths that two pages of a host share.
    """
    feats = pages.mapInPandas(_features, "host string, page long, path string, content boolean, feature long").distinct()
    feats = cut(feats, "features")
    m = feats.select("host", "path", "content", "page").distinct().groupBy("host", "path", "content").agg(F.count(F.lit(1)).alias("m"))
    k = feats.groupBy("host", "path", "content", "feature").agg(F.count(F.lit(1)).alias("k"))
    agg = k.groupBy("host", "path", "content").agg(
        F.count(F.lit(1)).alias("kinds"), F.sum(F.log("k")).alias("logs"), F.sum("k").alias("all"), F.sum(F.col("k") * F.log("k")).alias("klogk")
    )
    log_m = F.log(F.col("m").cast("double"))
    value = F.when(F.col("m") <= 1, F.lit(1.0)).when(
        F.col("content"), F.lit(1.0) - F.col("logs") / F.col("kinds") / log_m
    ).otherwise((F.log(F.col("all").cast("double")) - F.col("klogk") / F.col("all")) / log_m)
    nodes = agg.join(m, ["host", "path", "content"]).select("host", "path", "content", "m", value.alias("value"))
    of = lambda c: F.max(F.when(c, F.col("value")))
    nodes = nodes.groupBy("host", "path").agg(of(F.col("content")).alias("own"), of(~F.col("content")).alias("shown"), F.max("m").alias("m"))
    once = nodes.filter("m <= 1").select("host", F.regexp_replace("path", "/[^/]*$", "").alias("path")).distinct().withColumn("pinned", F.lit(True))
    nodes = nodes.filter("m > 1").join(once, ["host", "path"], "left").na.fill(False, ["pinned"])
    return nodes.groupBy("host").applyInPandas(_tree, "host string, paths array<string>")


def main_text(page: str, low: frozenset[str] = frozenset()) -> str:
    """The blocks of the article (of the whole body if there is none) outside skipped elements and low branches.
    Plain elements of an article are never removed for being repeated; marked ones and the rest of a page are."""
    blocks, _ = parse_blocks(page)
    if any(b.main and not b.skipped for b in blocks):
        blocks = [b for b in blocks if b.main]

    def dropped(b: Block) -> bool:
        if b.skipped:
            return True
        if not low or (b.main and b.plain):
            return False
        path = b.path
        while path:
            if path in low:
                return True
            path = path.rpartition("/")[0]
        return False

    return "\n".join(b.text for b in blocks if not dropped(b))


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        text = []
        for page, low in zip(df["html"], df["paths"], strict=True):
            text.append(main_text(page, frozenset(low) if low is not None else frozenset()))
        yield pd.DataFrame({"_row": df["_row"], "url": df["url"], "text": text})


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, text (blocks joined by newline, empty if none), n_chars (code points).

    Null html is empty; pages without a url are one site; repeated rows give equal texts; an empty table gives no
    rows; extra columns are ignored, whatever their names. Very long pages are parsed whole.
    """
    bounded_batches(pages.sparkSession)
    host = F.coalesce(F.regexp_extract(F.lower(F.col(url_col)), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("string").alias("_row"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host.alias("host")
    )
    style = cut(site_style(rows.select("host", "html")), "style")
    style = small(style, size=F.length(F.array_join("paths", "|")) + 64)
    out = rows.join(style, "host", "left").select("_row", "url", "html", "paths").mapInPandas(_extract, "_row string, url string, text string")
    kind = pages.schema[id_col].dataType.simpleString()
    return out.select(F.col("_row").cast(kind).alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
