"""Main text of web pages by consensus host paths.

1. Each page is read into blocks of text, each under a chain of containers. A container's score is the text below it
   outside links and outside boilerplate (by tag, role, class or id). From the body the page descends as long as one child
   container holds most of the score and what it leaves behind is no running text (an article or main is entered whatever
   is beside it); where it stops is the page's vote: its path of tags and generalised classes (digits and long
   hexadecimal runs replaced).
2. Votes are summed per host in Spark; paths with a fair share win.
3. Each page is read again with its host's winning paths: the blocks under the one whose share of the votes times its
   text on this page is largest, boilerplate left out, in page order. The page's own choice stands among them with the
   least share that wins, so a path with few votes has to hold nearly all of the page's text, one with all votes a tenth.

References are decoded, white space in a block becomes one space, blocks are joined by one space. Markup may be broken
or cut off anywhere. A null html, or one without text, gives an empty text. Pages without a host share an empty one.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenaria.llm.common import store

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
                        |<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^<>"']|"[^"<]*"|'[^'<]*')*+>|[^<>]*>?)""", re.S | re.X)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_NUMBER = re.compile(r"[0-9a-f]{8,}|\d+")

RAW = {"script", "style", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
          "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr"}
#: Blocks of running text; their score goes to the container around them.
TEXT = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "li", "ul", "ol", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot",
        "tr", "td", "th", "caption", "figure", "figcaption", "address", "center"}
BOILER_TAGS = {"head", "title", "nav", "header", "footer", "aside", "form", "button", "select", "option", "textarea", "fieldset", "dialog",
               "menu", "noscript", "template", "svg", "object", "iframe", "audio", "video", "canvas", "map"}
BOILER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar", "form"}
BOILER_WORDS = {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "aside",
                "widget", "widgets", "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored",
                "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup",
                "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related",
                "recommended", "recommendations", "comment", "comments", "disqus", "reply", "replies", "respond", "discussion", "pagination",
                "pager", "paging", "toolbar", "search", "form", "skip", "sponsors", "paywall"}
#: Words that an article's own parts are named by as well; they count only where nothing but them and PLAIN words is in the name.
TOPICS = {"discussion", "related", "social", "search", "notice", "notices", "notification", "alert", "banner", "overlay", "header", "form",
          "menu", "navigation", "promotion", "recommended", "recommendations", "respond", "reply", "replies", "comment", "comments", "share",
          "sharing", "login", "signup", "subscription", "subscribe", "consent", "skip", "paging", "ad", "advertising", "advertisement", "widget",
          "widgets", "cookie", "cookies", "sponsor", "sponsors", "sponsored", "modal", "popup", "toolbar", "footer"}
PLAIN = {"area", "bar", "block", "body", "box", "button", "buttons", "container", "content", "group", "icons", "inner", "items", "link", "links", "list",
         "main", "media", "panel", "post", "posts", "row", "section", "site", "slot", "top", "bottom", "left", "right", "unit", "us", "wrap", "wrapper", ""}
#: Lists and tables, which can be boxes as a whole; other blocks of running text and inline tags are none.
LISTS = {"ul", "ol", "dl", "table"}
#: On these only a whole class counts, as their classes often tell what the page has.
BROAD = {"html", "body", "main", "article"}
BROAD_WORDS = {"comment", "comments", "reply", "replies", "ad", "advert", "advertisement", "sponsored", "promo", "related", "teaser"}
_CLOSED_BY_BLOCK = {"p"}
#: Running text: a block of so many characters outside links, right in a container and in the containers beside.
OWN, BESIDE = 20, 60
_SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
         "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}


def _hints(rest: str) -> tuple[list[str], str, bool]:
    """(classes, id, marked as boilerplate by role or hidden); of an attribute given twice the first counts."""
    have: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(rest):
        have.setdefault(name.lower(), a or b or c.strip("\"'"))
    off = "hidden" in have or have.get("aria-hidden", "").strip().lower() == "true" or have.get("role", "").strip().lower() in BOILER_ROLES
    return have.get("class", "").split(), have.get("id", ""), off


def _boiler(tag: str, classes: list[str], own_id: str) -> bool:
    """Whether the names of a container make it boilerplate; ids of sections, and any of running text, are its topics."""
    if tag in INLINE or tag in TEXT and tag not in LISTS:
        return False
    for n in classes if tag == "section" else [*classes, own_id]:
        words = _SPLIT.split(_CAMEL.sub("-", n).lower())
        if tag in BROAD:
            if n.lower() in BROAD_WORDS or words[0] == "comment":
                return True
        elif words[0] not in ("has", "with", "without", "no", "is", "hide", "show") and (found := BOILER_WORDS.intersection(words)):
            if found - TOPICS or all(w in BOILER_WORDS or w in PLAIN or w.isdigit() for w in words):
                return True
    return False


class Page:
    """Blocks of a page and the containers they lie in."""

    def __init__(self, source: str, by_hints: bool = True):
        self.paths: list[str] = ["html"]  # of each container
        self.parents: list[int] = [-1]
        self.scores: list[float] = [0.0]
        self.running: list[float] = [0.0]  # score of the longest block right in it
        self.blocks: list[tuple[int, str]] = []  # (container, text) outside boilerplate
        self._pieces: list[str] = []
        self._linked = 0
        self._read(source, by_hints)

    def _flush(self, container: int, boiler: bool) -> None:
        if self._pieces:
            text = " ".join("".join(self._pieces).split())
            if text and not boiler:
                self.blocks.append((container, text))
                score = max(0, len(text) - 2 * self._linked)
                self.scores[container] += score
                self.running[container] = max(self.running[container], score)
            self._pieces = []
        self._linked = 0

    def _read(self, source: str, by_hints: bool) -> None:
        stack: list[tuple[str, int, bool]] = [("html", 0, False)]  # (tag, container, in boilerplate)
        open_: Counter[str] = Counter({"html": 1})
        links = at = 0

        def text(piece: str) -> None:
            nonlocal links
            if piece and not stack[-1][2]:
                piece = _html.unescape(piece)
                self._pieces.append(piece)
                if open_["a"]:
                    self._linked += len(piece.strip())

        def pop(to: int) -> None:
            while len(stack) > to:
                tag, container, boiler = stack[-1]
                if tag not in INLINE:
                    self._flush(container, boiler)
                stack.pop()
                open_[tag] -= 1

        def find(tags: set[str], stop: set[str]) -> int:
            if not any(open_[t] > 0 for t in tags):
                return -1
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in tags:
                    return i
                if stack[i][0] in stop:
                    return -1
            return -1

        for m in iter(lambda: _TOKEN.search(source, at), None):
            text(source[at: m.start()])
            at = m.end() if m.end() > m.start() else m.start() + 1
            if m.group("tag") is None:
                continue
            tag, rest = m.group("tag").lower(), m.group("rest")
            if m.group("end"):
                if tag in INLINE:
                    i = find({tag}, set())
                    if i > 0 and all(x[0] in INLINE for x in stack[i:]):
                        pop(i)
                elif tag not in ("html", "body") and open_[tag] > 0:
                    i = find({tag}, set())
                    if i > 0:
                        pop(i)
                elif tag in ("p", "br"):
                    self._flush(*stack[-1][1:])
                continue
            if tag in RAW:
                close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(source, at)
                at = close.end() if close else len(source)
                continue
            if tag == "br":
                text(" ")
                continue
            if tag not in INLINE:
                if open_["head"] > 0 and tag not in BOILER_TAGS | VOID:
                    pop(find({"head"}, set()))
                if tag in _SAME and (i := find(*_SAME[tag])) > 0:
                    pop(i)
                elif open_["p"] > 0 and tag not in ("td", "th", "tr") and (i := find({"p"}, {"td", "th", "table", "button", "object"})) > 0:
                    pop(i)
                self._flush(*self._place(stack))
            if tag in VOID or tag == "html":
                continue
            _, container, boiler = stack[-1]
            classes, own_id, off = _hints(rest) if len(rest) > 1 else ([], "", False)
            if tag not in BROAD and (tag in BOILER_TAGS or off) or by_hints and (classes or own_id) and _boiler(tag, classes, own_id):
                boiler = True
            if tag not in INLINE and tag not in TEXT:
                path = tag + "".join(f".{c}" for c in sorted({_NUMBER.sub("#", c.lower()) for c in classes}))
                self.paths.append(f"{self.paths[container]}/{path}")
                self.parents.append(container)
                self.scores.append(0.0)
                self.running.append(0.0)
                container = len(self.paths) - 1
            stack.append((tag, container, boiler))
            open_[tag] += 1
        text(source[at:])
        pop(0)

    @staticmethod
    def _place(stack) -> tuple[int, bool]:
        return stack[-1][1:]

    def choice(self, most: float = 0.7) -> int:
        """The container the page votes for."""
        total, running = self.scores[:], self.running[:]
        children: list[list[int]] = [[] for _ in total]
        for i in range(len(total) - 1, 0, -1):
            total[self.parents[i]] += total[i]
            running[i] = max([running[i], *(running[k] for k in children[i])])
            children[self.parents[i]].append(i)
        at, inside = 0, False
        while children[at] and total[at] > 0:
            best = max(children[at], key=lambda i: (total[i], -i))
            if total[best] < most * total[at]:
                break
            enters = self.paths[best].rpartition("/")[2].partition(".")[0] in ("article", "main")
            beside = max((running[i] for i in children[at] if i != best), default=0)
            if not enters and (self.running[at] >= OWN or beside >= (1 if inside else BESIDE)):
                break
            at, inside = best, inside or enters
        return at

    def under(self, wanted: set[int]) -> list[str]:
        """Texts of the blocks below any of the containers."""
        inside = [False] * len(self.paths)
        for i, p in enumerate(self.parents):
            inside[i] = i in wanted or p >= 0 and inside[p]
        return [t for c, t in self.blocks if inside[c]]


def extract(source: str, winners: list[tuple[str, float]], least: float = 0.1) -> str:
    """The page's text by its host's ``winners`` (path, share of the votes) and its own choice, which counts ``least``."""
    for by_hints in (True, False):
        page = Page(source, by_hints)
        blocks = page.under({page.choice()})
        most = least * sum(map(len, blocks))
        for path, share in winners:
            found = {i for i, p in enumerate(page.paths) if p == path}
            if found and share * sum(map(len, there := page.under(found))) > most:
                blocks, most = there, share * sum(map(len, there))
        if blocks:
            return " ".join(blocks)
    return ""


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes: Counter[tuple[str, str]] = Counter()
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            page = Page(source or "")
            if page.blocks:
                votes[host, page.paths[page.choice()]] += 1
        hosts, paths = zip(*votes) if votes else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(list(votes.values()), pa.int64())],
                                         names=["host", "path", "votes"])


def _extracted(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(s or "", [(x["path"], x["share"]) for x in w or []], least)
                     for s, w in zip(batch.column("html").to_pylist(), batch.column("winners").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])
    return run


def main_text(pages: DataFrame, share: float = 0.1) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; a host's winning paths have ``share`` of its votes or more."""
    host = F.coalesce(F.regexp_extract("url", "://([^/?#]*)", 1), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), F.col("html").cast("string").alias("html"))
    votes = store(pages.select("host", "html").mapInArrow(_votes, "host string, path string, votes long")
                  .groupBy("host", "path").agg(F.sum("votes").alias("votes")), "html-votes")
    of_host = votes.groupBy("host").agg(F.sum("votes").alias("cast"))
    # at most 1 / share paths for each host
    winners = store(votes.join(of_host, "host").where(F.col("votes") >= share * F.col("cast")).groupBy("host")
                    .agg(F.sort_array(F.collect_list(F.struct((F.col("votes") / F.col("cast")).alias("share"), "path")), asc=False).alias("winners")),
                    "html-winners")
    return (pages.join(winners, "host", "left").select("page_id", "url", "html", "winners")
            .mapInArrow(_extracted(share), "page_id long, url string, text string, n_chars long"))
