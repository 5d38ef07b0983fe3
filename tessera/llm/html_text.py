"""Main text of web pages by consensus host paths.

A first pass parses each page, scores its containers by the text that they hold, and names each by
its generalised path: tags and classes from the body down, digits replaced, held as the last tag and
a 128-bit hash of the whole, so paths of any depth stay apart. Spark counts, for each
host, how many pages each path won; a second pass takes from every page the containers on its
host's winning path, and from a page that has none its own best container.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are
left out by tag, role and class name. Names that may as well stand for parts of an article ("legal",
"toc", "related") decide alone outside one only; within, such a block goes if most of its text is
links. A button or label in a paragraph is part of the sentence. The text of a block has its character references decoded and
its white space turned into single blanks; blocks are joined by newlines in page order."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import narrowed, salted, small_batches, small_enough, stored

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|title|iframe|xmp|noembed|noframes)\b[^>]*>.*?(?:</\1\b[^>]*>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
#: One attribute after another, so that words within a value are no names.
_ATTRIBUTE = re.compile(r"([^\s/=][^\s/=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s\"'][^\s]*+)?))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
_CONTAINER = frozenset("article body blockquote center div main section td".split())
_DROP = frozenset("aside button canvas datalist dialog footer form head menu nav object search select svg audio video input label fieldset".split())
#: Of these, what a sentence may hold.
_IN_SENTENCE = frozenset(("button", "label"))
_CLOSES_P = _BLOCK - {"option", "optgroup", "body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "caption"}
_SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"},
}
_FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}}
_BAD = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|adbox|adsense|sponsor|sponsored|promo|promotion|promoted|nav|navbar|navigation|menu|menubar|breadcrumbs?|"
    r"sidebar|side-?bar|aside|footer|site-?header|page-?header|cookies?|consent|gdpr|notices?|notification|alert|disclaimer|popup|modal|overlay|newsletter|subscribe|"
    r"signup|sign-?in|login|comments?|commentlist|comment-?section|disqus|replies|reply|respond|responses|reactions|discussion|social|share|sharing|sharebar|"
    r"toolbar|pagination|pager|searchbox|hidden|sr-only|visually-hidden|copyright)(?:$|[\s_-])",
    re.I,
)
_MAYBE = re.compile(
    r"(?:^|[\s_-])(?:banner|rail|foot|masthead|topbar|subscription|follow|related|recommended|recommendations|read-?more|more-?stories|trending|widgets?|search|toc|skip|tags|tagcloud|legal)(?:$|[\s_-])",
    re.I,
)
_BAD_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
#: Wrappers say what a page has or lacks ("with-sidebar"); that is not what they are.
_STATE = re.compile(r"(?:^|(?<=\s))(?:has|with|no|without|is|show|shows|hide|open|toggle)[-_][\w-]+", re.I)
_HEAD = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.I)
_GOOD = re.compile(r"(?:^|[\s_-])(?:article|articlebody|content|entry|post|story|main|text|body|prose)(?:$|[\s_-])", re.I)
_DIGITS = re.compile(r"\d+")
_DECAY = 0.7


class _Page:
    """A parsed page: containers (parent, path, good) and blocks (container, text, linked chars)."""

    __slots__ = ("parent", "path", "good", "blocks")

    def __init__(self, html: str):
        self.parent, self.path, self.good = [-1], [""], [False]
        self.blocks: list[tuple[int, str, int]] = []
        self._parse(html)

    def _parse(self, html: str) -> None:
        # An open element: tag, its container, whether its text is dropped, whether in an article,
        # the innermost doubtful element around it (-1: none).
        stack: list[tuple[str, int, bool, bool, int]] = [("", 0, False, False, -1)]
        # Depths of open elements: by tag, of all blocks, of all containers.
        depths: dict[str, list[int]] = defaultdict(list)
        open_blocks: list[int] = []
        open_boxes: list[int] = []
        doubtful: list[int] = []  # the doubtful element around each one
        doubts: list[int] = []  # of each block
        hashes = [b""]
        text: list[str] = []
        links = at = in_link = 0

        def end_block() -> None:
            nonlocal text, links
            if text:
                said = " ".join("".join(text).split())
                if said:
                    self.blocks.append((stack[-1][1], said, min(links, len(said))))
                    doubts.append(stack[-1][4])
                text = []
            links = 0

        def pop_to(depth: int) -> None:
            if open_blocks and open_blocks[-1] >= depth:
                end_block()
            for tag, *_ in stack[depth:]:
                depths[tag].pop()
            del stack[depth:]
            for held in (open_blocks, open_boxes):
                while held and held[-1] >= depth:
                    held.pop()

        def add(part: str) -> None:
            nonlocal links
            if part and not stack[-1][2]:
                part = unescape(part) if "&" in part else part
                text.append(part)
                if in_link:
                    links += len(part)

        for m in _TOKEN.finditer(html):
            if m.start() > at:
                add(html[at : m.start()])
            at = m.end()
            tag = m[3] or m[6]
            if not tag:
                continue
            tag, closing = tag.lower(), m[2] or m[5]
            if closing:
                if tag == "a":
                    in_link = 0
                if tag == "br":
                    add(" ")
                if depths[tag] and (tag in _BLOCK or not open_boxes or depths[tag][-1] > open_boxes[-1]):
                    pop_to(depths[tag][-1])
                elif tag in _BLOCK:
                    end_block()
                continue
            if tag in _VOID:
                if tag == "hr":
                    end_block()
                elif tag in ("br", "wbr"):
                    add(" " if tag == "br" else "")
                continue
            if tag in _CLOSES_P and open_blocks and stack[open_blocks[-1]][0] == "p":
                pop_to(open_blocks[-1])
            if tag in _SIBLINGS:
                fence = max((depths[f][-1] for f in _FENCE.get(tag, ()) if depths[f]), default=0)
                cut = [d[i] for d in map(depths.__getitem__, _SIBLINGS[tag]) if (i := bisect_right(d, fence)) < len(d)]
                if cut:
                    pop_to(min(cut))
            if tag in _BLOCK:
                end_block()
            if tag == "a":
                in_link = 1
            rest = m[4] if m[3] else m[7]
            names, role, hidden = "", "", False
            if rest and not rest.isspace():
                for n in _ATTRIBUTE.finditer(rest):
                    value = n[2] or n[3] or n[4] or ""
                    what = n[1].lower()
                    if what in ("class", "id"):
                        names += f" {value}" if what == "class" else f"  {value}"
                    elif what == "role":
                        role = value.lower()
                    elif what == "hidden" or (what == "aria-hidden" and value.lower() == "true"):
                        hidden = True
            _, box, drop, inside, doubt = stack[-1]
            inside = inside or tag in ("article", "main")
            if not drop and tag not in ("body", "html"):
                names, full = _DIGITS.sub("", _STATE.sub("", names)), names
                sentence = tag in _IN_SENTENCE and bool(open_blocks) and stack[open_blocks[-1]][0] == "p"
                drop = hidden or (tag in _DROP and not sentence) or role in _BAD_ROLE
                drop = drop or (not inside and (tag == "header" or bool(_HEAD.search(names))))
                if not drop and names and tag not in ("article", "main"):
                    drop = bool(_BAD.search(names))
                    if not drop and _MAYBE.search(names):
                        drop = not inside
                        if inside and tag in _BLOCK:
                            doubtful.append(doubt)
                            doubt = len(doubtful) - 1
                drop = drop or (tag == "article" and bool(re.search(r"(?:^|[\s_-])comments?(?:$|[\s_-])", names, re.I)))
                names = full
            if tag in _BLOCK:
                open_blocks.append(len(stack))
            if tag in _CONTAINER:
                open_boxes.append(len(stack))
                label = tag + "".join(f".{c}" for c in _DIGITS.sub("#", names).lower().split("  ")[0].split())
                whole = xxhash.xxh3_128(hashes[box] + label.encode("utf-8", "surrogatepass"))
                hashes.append(whole.digest())
                self.parent.append(box)
                self.path.append(f"{tag}#{whole.hexdigest()}")
                self.good.append(tag in ("article", "main") or bool(_GOOD.search(names)))
                box = len(self.parent) - 1
            depths[tag].append(len(stack))
            stack.append((tag, box, drop, inside, doubt))
        if at < len(html):
            add(html[at:])
        end_block()
        if doubtful:
            self._judge(doubtful, doubts)

    def _judge(self, doubtful: list[int], doubts: list[int]) -> None:
        """Drops the blocks of doubtful elements whose text is mostly links."""
        size, linked = [0] * len(doubtful), [0] * len(doubtful)
        for d, (_, said, n) in zip(doubts, self.blocks):
            if d >= 0:
                size[d] += len(said)
                linked[d] += n
        for d in range(len(doubtful) - 1, -1, -1):  # elements come before what they hold
            if doubtful[d] >= 0:
                size[doubtful[d]] += size[d]
                linked[doubtful[d]] += linked[d]
        gone = [2 * n > s for n, s in zip(linked, size)]
        for d, around in enumerate(doubtful):
            gone[d] = gone[d] or (around >= 0 and gone[around])
        self.blocks = [b for d, b in zip(doubts, self.blocks) if d < 0 or not gone[d]]

    def scores(self) -> list[float]:
        """What each container's text weighs; that of containers in it counts less by depth."""
        score = [0.0] * len(self.parent)
        for box, said, linked in self.blocks:
            score[box] += len(said) - 0.9 * linked
        for i in range(len(score) - 1, 0, -1):  # parents come before what they hold
            score[self.parent[i]] += _DECAY * score[i]
        return [s * (1.5 if g else 1.0) for s, g in zip(score, self.good)]

    def best(self) -> int:
        score = self.scores()
        return max(range(len(score)), key=lambda i: (score[i], -i))

    def text(self, chosen: set[int]) -> str:
        inside = [False] * len(self.parent)
        for i in range(len(self.parent)):
            inside[i] = i in chosen or (self.parent[i] >= 0 and inside[self.parent[i]])
        return "\n".join(said for box, said, _ in self.blocks if inside[box])


def best_path(html: str | None) -> tuple[str, float] | None:
    """Path and score of the page's best container; None if the page has no text."""
    page = _Page(html or "")
    if not page.blocks:
        return None
    i = page.best()
    return page.path[i], page.scores()[i]


def extract(html: str | None, path: str | None) -> str:
    """The text of the containers on `path`, or of the page's best one if there is none."""
    page = _Page(html or "")
    chosen = {i for i, p in enumerate(page.path) if p == path} if path is not None else set()
    said = page.text(chosen) if chosen else ""
    return said or (page.text({page.best()}) if page.blocks else "")


def host(url: F.Column) -> F.Column:
    """Lower-cased host of a URL; '' for null and for what has none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


def winning_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path, votes): the path that won most of the host's pages, then most text, then the
    lesser path. Votes and winners are combined before each shuffle, so a hot host is no hot task."""
    own = narrowed(pages, url=url, html=html).select(host(F.col("url")).alias("host"), "html")

    def run(batches):
        for batch in batches:
            hosts, paths, scores = [], [], []
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if found := best_path(text):
                    hosts.append(h)
                    paths.append(found[0])
                    scores.append(int(found[1]))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.int64())], ["host", "path", "score"])

    votes = small_batches(own).mapInArrow(run, "host string, path string, score long")
    votes = votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("score").alias("score"))
    best = F.min(F.struct((-F.col("votes")).alias("votes"), (-F.col("score")).alias("score"), "path")).alias("b")
    return votes.groupBy("host").agg(best).select("host", F.col("b.path").alias("path"), (-F.col("b.votes")).alias("votes"))


def main_text(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", broadcast_hosts: int = 100_000) -> DataFrame:
    """(page_id, url, text, n_chars, path) for each row of pages; the text is empty if there is
    none, path is null where the page's own best container was taken for want of a host's vote.

    Null and empty pages have no text; rows that repeat an id are pages of their own; a null url's
    host is ''. Other columns play no part. The winning paths are broadcast if they are counted to
    be at most `broadcast_hosts`; else pages are shuffled by host, those of hot hosts salted."""
    own = narrowed(pages, page_id=id, url=url, html=html)
    paths = stored(winning_paths(own), "paths").select(F.col("host").alias("h"), "path")
    rows = own.withColumn("h", host(F.col("url")))
    if small_enough(paths, broadcast_hosts):
        rows = rows.join(F.broadcast(paths), "h", "left")
    else:
        counts = stored(rows.groupBy("h").agg(F.count("*").alias("rows")), "hosts")
        rows = salted(rows, counts.select("h").join(paths, "h", "left"), "h", ["page_id", "url"], counts)

    @F.arrow_udf("string")
    def run(pages: pa.Array, paths: pa.Array) -> pa.Array:
        return pa.array([extract(h, p) for h, p in zip(pages.to_pylist(), paths.to_pylist())], pa.string())

    rows = rows.select("page_id", "url", run("html", "path").alias("text"), "path")
    return rows.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "path")
