"""Main text of web pages: each page's own container, without what its host repeats.

A page's text is that of the smallest container that holds all of its unlinked prose outside
furniture. Furniture is named by tags (headers inside an article as well), roles and classes, or found by a consensus of the host:
every page lists what stands beside the container with most of its prose, by a path of tags and
classes (digits generalised). A path that has the same texts again and again on the pages of a
host is furniture on all of them, unless a page has no prose but there. A page without a host
knows only named furniture.

A class with a word that may also be an article's subject (social, notice) names furniture only if
its other words name parts of a page, and never around most of the prose; if names leave no prose,
they are not used.

A null or empty page, and one without prose, has an empty text. Repeated rows count and are
extracted as often as they occur; an empty table gives an empty one. What stands beside the main
container and is the same on most pages of a host is taken for furniture even if it is prose.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import materialise
from fieldglass.llm.url_rules import host_of

#: Hosts whose furniture is sent to every task; more are joined.
MAX_HOSTS = 100_000
#: What stands outside the deepest container with this share of the page's prose is compared across the host.
MIN_SHARE = 0.6
#: A path is furniture from this many pages of a host on, if no more than this share of them have a text of their own there.
MIN_PAGES, MAX_TEXTS = 3, 0.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags whose whole content is no article text.
SKIPPED = frozenset("head title script style noscript template iframe svg math canvas audio video object nav header footer aside form button select textarea menu dialog".split())
CONTAINERS = frozenset("body main article section div td".split())
#: Tags that start and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: An opening tag on the left ends an open element of the tags on the right.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead"), "thead": ("tbody",)}
#: An element left open is not looked for beyond these.
SCOPES = CONTAINERS | {"ul", "ol", "table", "blockquote"}
#: Class and id words of page furniture.
FURNITURE = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense sponsored banner cookie cookies consent gdpr nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead topbar"
    " comment comments commentlist replies respond disqus newsletter signup login popup modal pagination pager skip".split())
#: Words that name furniture but subjects of articles too: they count if the rest of the class is no other subject, and not for most of a page's prose.
SUBJECTS = frozenset(
    "sponsor promo promotion notice notices notification alert menu aside reply discussion share sharing social related recommended subscribe subscription overlay toolbar widget copyright hidden header".split())
#: Words that may stand beside a subject in the name of furniture.
NEUTRAL = frozenset(
    "area article articles bar block body bottom box btn button buttons container content entry icon icons inner item items left link links list main outer page panel post posts right row section site text title top wrap wrapper".split())
#: Classes that sort articles by subject start so.
SORTED = ("category-", "tag-", "topic-")
WORD = re.compile(r"[a-z]+")
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Comments and elements whose content is not markup.
RAW = re.compile(
    r"<!--.*?(?:-->|\Z)|<svg\b(?:[^<>\"'/]++|/(?!>)|\"[^\"]*+\"|'[^']*+')*+/>"
    r"|<(script|style|textarea|title|noscript|iframe|template|svg)\b[^>]*>(?:.*?</\1\s*>|.*\Z)", re.I | re.S)
TAG = re.compile(r"<(?:(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)|[!?][^>]*)>")
#: One attribute, with its value, or a stray quoted string.
ATTR = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?|\"[^\"]*\"|'[^']*'")


def furniture_name(tag: str, names: str) -> int:
    """What the class and id words of an element say: 2 that it is furniture, 1 that it may be, 0 nothing."""
    found = 0
    for name in names.lower().split():
        words = [] if name.startswith(SORTED) else WORD.findall(name)
        known = [w for w in words if w in FURNITURE]
        if known:
            return 2
        subjects = [w for w in words if w in SUBJECTS]
        if subjects and len(subjects) + sum(w in NEUTRAL for w in words) == len(words) and (subjects != ["header"] or len(words) == 1 or words[0] in ("site", "page", "top")):
            found = 1
    return found


class Page:
    """The parts of a page: nodes (parent, path, inside furniture, container) and text with the node it stands in, in page order.

    ``hard``: inside furniture by tag, role or style alone. ``dropped``: by name as well.
    """

    __slots__ = ("parents", "paths", "hard", "dropped", "containers", "texts")

    def __init__(self, html: str):
        self.parents, self.paths, self.hard, self.containers = [-1], [""], [False], [False]
        named = [0]
        self.texts: list[tuple[int, str | None, bool]] = []
        stack: list[tuple[str, int]] = [("", 0)]
        links = 0
        parts = TAG.split(RAW.sub("", html))
        texts, top = self.texts, 0
        for k in range(0, len(parts), 4):
            if parts[k]:
                texts.append((top, parts[k], links > 0))
            tag = parts[k + 2] if k + 2 < len(parts) else None
            if tag is None:
                continue
            tag = tag.lower()
            block = tag in BLOCKS
            if block:
                texts.append((top, None, False))
            if parts[k + 1]:
                at = len(stack) - 1
                while at and stack[at][0] != tag:
                    # an inline element that was left open does not end the blocks opened since
                    at = 0 if not block and stack[at][0] in BLOCKS else at - 1
                if at:
                    links -= sum(t == "a" for t, _ in stack[at:])
                    del stack[at:]
                    top = stack[-1][1]
                continue
            if tag == "br":
                texts.append((top, " ", False))
            # of elements with content only those of SVG and MathML can close themselves
            if tag in VOID or (tag in ("svg", "math") and parts[k + 3].endswith("/")):
                continue
            if block or tag in ENDS:
                ended = ENDS.get(tag, ())
                for at in range(len(stack) - 1, 0, -1):
                    name = stack[at][0]
                    if name in ended or (block and name == "p"):
                        links -= sum(t == "a" for t, _ in stack[at:])
                        del stack[at:]
                        break
                    if name in SCOPES:
                        break
            parent, raw = stack[-1][1], parts[k + 3]
            attrs = {a[0].lower(): a[1] or a[2] or a[3] for a in ATTR.findall(raw)} if raw else {}
            drop, path, name = self.hard[parent] or tag in SKIPPED, tag, 0
            if attrs:
                if tag not in ("html", "body", "main", "article"):
                    name = furniture_name(tag, " ".join(attrs[a] for a in ("class", "id") if a in attrs))
                drop = (
                    drop or attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true"
                    or re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I) is not None)
                path = ".".join([tag, *sorted(set(re.sub(r"\d+", "0", attrs.get("class", "")).lower().split()))])
            self.parents.append(parent)
            self.paths.append(f"{self.paths[parent]}>{path}")
            self.hard.append(drop)
            named.append(name)
            self.containers.append(tag in CONTAINERS and not drop)
            top = len(self.parents) - 1
            stack.append((tag, top))
            links += tag == "a"
        prose = self.prose(self.hard) if 1 in named else [0] * len(named)
        self.dropped = list(self.hard)
        for node in range(1, len(named)):  # a parent stands before its children
            by_name = named[node] == 2 or (named[node] == 1 and 2 * prose[node] <= prose[0])
            self.dropped[node] = self.dropped[node] or self.dropped[self.parents[node]] or by_name
        if 2 in named and not any(t is not None and t.strip() and not linked and not self.dropped[node] for node, t, linked in self.texts):
            self.dropped = list(self.hard)  # the names leave nothing: they name no furniture here

    def prose(self, dropped: list[bool]) -> list[int]:
        """Unlinked characters in and below each node."""
        prose = [0] * len(self.parents)
        for node, text, linked in self.texts:
            if text is not None and not linked and not dropped[node]:
                prose[node] += len(text.strip())
        for node in range(len(prose) - 1, 0, -1):  # a parent stands before its children
            prose[self.parents[node]] += prose[node]
        return prose

    def best(self, prose: list[int], dropped: list[bool], share: float) -> int:
        """The deepest container with this share of the prose; 0 without one."""
        found = 0
        for node in range(1, len(prose)):
            if prose[0] and self.containers[node] and not dropped[node] and prose[node] >= prose[0] * share:
                found = node  # nodes with more than half of the prose lie in each other
        return found

    def beside(self) -> list[tuple[str, str | None]]:
        """Path and text of every element with prose that stands beside the container with most of it, or beside one around that; these containers and all in the first without text."""
        prose = self.prose(self.dropped)
        node = self.best(prose, self.dropped, MIN_SHARE)
        if not node:
            return []
        main, around = node, {0}
        while node > 0:
            around.add(node)
            node = self.parents[node]
        own, unit, texts = {self.paths[k] for k in around if k}, [0] * len(self.parents), {}
        for k in range(1, len(unit)):
            parent = self.parents[k]
            if k in around or not prose[k] or self.dropped[k]:
                continue
            if parent == main or unit[parent] == main:
                unit[k] = main
                own.add(self.paths[k])
            else:
                unit[k] = unit[parent] or k
        for k, text, _ in self.texts:
            if text is not None and unit[k] not in (0, main) and not self.dropped[k]:
                texts.setdefault(unit[k], []).append(text)
        return [*((p, None) for p in own), *((self.paths[k], " ".join("".join(t).split())) for k, t in texts.items())]

    def text(self, furniture=None) -> str:
        """Blocks of the smallest container with all prose outside ``furniture``, paths of the host; of all prose if there is none outside."""
        dropped = list(self.dropped)
        if furniture is not None and len(furniture):
            named = set(furniture)
            for node in range(1, len(dropped)):
                dropped[node] = dropped[node] or dropped[self.parents[node]] or self.paths[node] in named
        prose = self.prose(dropped)
        if not prose[0]:
            dropped = self.dropped
            prose = self.prose(dropped)
            if not prose[0]:
                return ""
        top = self.best(prose, dropped, 1)
        inside = [False] * len(self.parents)
        for node, parent in enumerate(self.parents):
            inside[node] = not dropped[node] and ((parent >= 0 and inside[parent]) or node == top)
        blocks, now = [], []
        for node, text, _ in [*self.texts, (0, None, False)]:
            if text is None:
                if now:
                    blocks.append(" ".join(unescape("".join(now)).split()))
                    now = []
            elif inside[node]:
                now.append(text)
        return "\n\n".join(b for b in blocks if b)


def host_furniture(pages: DataFrame) -> DataFrame:
    """``host`` and ``paths`` for every host that has furniture."""
    def listed(frames):
        import pandas as pd
        import xxhash

        for frame in frames:
            rows = []
            for host, html in zip(frame["host"], frame["html"], strict=True):
                # a path counts once a page, with all its texts there
                texts: dict[str, list[str | None]] = {}
                for path, text in Page(html).beside():
                    texts.setdefault(path, []).append(text)
                rows += [(host, p, None if None in t else xxhash.xxh64_hexdigest("\n".join(t).encode("utf-8", "surrogatepass"))) for p, t in texts.items()]
            yield pd.DataFrame(rows, columns=["host", "path", "text"])

    found = pages.where("host != '' AND html IS NOT NULL").select("host", "html").mapInPandas(listed, "host string, path string, text string")
    # where a path holds most of a page's prose, its text counts as one of its own
    own = F.when(F.col("text").isNull(), F.col("n")).otherwise(1)
    counts = found.groupBy("host", "path", "text").agg(F.count("*").alias("n")).groupBy("host", "path").agg(F.sum("n").alias("pages"), F.sum(own).alias("texts"))
    repeated = counts.where((F.col("pages") >= MIN_PAGES) & (F.col("texts") <= F.col("pages") * MAX_TEXTS))
    return repeated.groupBy("host").agg(F.collect_list("path").alias("paths"))


def extract(pages: DataFrame, max_hosts: int = MAX_HOSTS) -> DataFrame:
    """``pages`` with ``__text``, the main text, for columns ``url`` and ``html``."""
    named = pages.withColumn("__host", F.coalesce(host_of(F.col("url")), F.lit("")))
    found = materialise(host_furniture(named.select(F.col("__host").alias("host"), "html")).select(F.col("host").alias("__host"), F.col("paths").alias("__paths")), "host_furniture")
    # one short row for each host: sent to all tasks while they are few, else joined
    side = F.broadcast(found) if found.count() <= max_hosts else found

    @F.pandas_udf("string")
    def text(htmls, paths):
        import pandas as pd

        return pd.Series([Page(h).text(p) if h else "" for h, p in zip(htmls, paths, strict=True)], dtype=object)

    return named.join(side, "__host", "left").withColumn("__text", text(F.col("html"), F.col("__paths"))).drop("__host", "__paths")


def page_texts(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id``, ``url``, ``text``, ``n_chars``."""
    found = extract(pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("__text").alias("text"), F.length("__text").cast("bigint").alias("n_chars"))
