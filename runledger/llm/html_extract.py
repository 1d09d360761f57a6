"""Main text of web pages by consensus host paths.

Each page's containers are scored by the text of the blocks they hold directly; every page votes for the generalised
tag-class path of its best container. Spark adds the votes per host. Of the containers that hold most of a page's best
score, the page is extracted at the one whose path won most votes of its host: the best one, where it stands alone. The
text is that of the article around the container, if there is one."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lean

#: Rows up to which the choices between containers may be broadcast.
BROADCAST_CHOICES = 50_000
#: The attributes of a tag: a quoted value may hold anything, where its quote is closed; all else ends at < or >. Nothing is
#: tried twice, and no attempt reads far beyond the tag, so a page is read in linear time whatever it holds.
_ATTRIBUTES = r"""(?:=\s*+(?:"[^"]*+"|'[^']*+')|[^<>])*+"""
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|object)\b(?>" + _ATTRIBUTES + r")>.*?(?:</\1\s*+>|\Z)|<[!?][^<>]*+>?"
    r"|<(/?)([a-zA-Z][\w:-]*+)(" + _ATTRIBUTES + r")>?",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CONTAINER = frozenset("body main article section div td center blockquote".split())
_BLOCK = _CONTAINER | frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd pre table tr th thead tbody figure figcaption header footer nav aside form fieldset hr address html head title details summary".split())
_VOID = frozenset("br hr img input meta link source wbr area base col embed param track".split())
_SKIP = frozenset("head title nav header footer aside form button fieldset menu dialog".split())
#: Whole class, id and role tokens that mark waste.
_WASTE = re.compile(r"(?:(?:site|page|main|global|top|bottom)[-_])?(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|nav\w*|menu|breadcrumbs?|sidebar|side|widgets?|footer|header|masthead|comments?|replies|reply|disqus|respond|related|share|social|popup|modal|newsletter|subscribe|login|search|form)(?:[-_]?(?:\d+|area|banner|bar|box|buttons?|form|links|list|notice|posts|slot))?", re.I)
#: Elements that no class or id makes waste, and those that show that what is around them is not waste.
_NEVER, _CONTENT = frozenset("html body main article".split()), frozenset("main h1".split())
_LINK = re.compile(r"<(/?)a(?=[\s/>])", re.I)
_ENDS_P = _BLOCK - frozenset(["br"])


def _name(tag: str, attributes: str) -> tuple[str, bool]:
    """The generalised step of a path, and whether a class, id or role marks waste."""
    kept, waste = [], False
    for m in _ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        waste = waste or tag not in _NEVER and any(map(_WASTE.fullmatch, value.split()))
        if m[1].lower() == "class":
            kept = sorted({re.sub(r"\d+", "N", c.lower()) for c in value.split()})
    return ".".join([tag, *kept]), waste


Block = tuple[int, str, int, bool]


class Paths:
    """Generalised paths of a page's containers, by number; 0 is the page itself. Containers of one path share a number."""

    def __init__(self) -> None:
        self.up, self.step = [0], [""]
        self._known: dict[tuple[int, str], int] = {}

    def under(self, up: int, step: str) -> int:
        at = self._known.setdefault((up, step), len(self.up))
        if at == len(self.up):
            self.up.append(up)
            self.step.append(step)
        return at

    def text(self, at: int) -> str:
        steps = []
        while at:
            steps.append(self.step[at])
            at = self.up[at]
        return "".join("/" + x for x in reversed(steps))


def blocks(page: str) -> tuple[Paths, list[Block]]:
    """(path of the container, text, characters inside links, in a paragraph) of the page's blocks, without waste.

    What a class, id or role marks is no waste where it holds the page's heading, <main> or first <article>, or where nothing else is left."""
    paths = Paths()
    out: list[tuple[int, str, int, bool, int]] = []
    stack: list[tuple[str, int, bool, int]] = [("", 0, False, 0)]  # tag, path of the innermost container, within a skipped tag, innermost marked element
    open_: dict[str, int] = {}  # how often a tag is in the stack
    around, content = [0], {0}  # the marked element around each; those that hold the page's heading, <main> or first <article>
    articles = 0
    pieces: list[str] = []
    linked, in_link, at = 0, False, 0

    def flush() -> None:
        nonlocal pieces, linked
        text = " ".join(entities.unescape("".join(pieces)).split()) if pieces else ""
        if text and not stack[-1][2]:
            out.append((stack[-1][1], text, linked, any(t[0] in ("p", "pre", "h1", "h2", "h3", "li") for t in stack[-3:]), stack[-1][3]))
        pieces, linked = [], 0

    def pop(k: int) -> None:
        for t in stack[k:]:
            open_[t[0]] -= 1
        del stack[k:]

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            pieces.append(page[at : m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        if m[3] is None:
            continue
        tag = m[3].lower()
        if tag in _BLOCK:
            flush()
        elif tag == "br":
            pieces.append(" ")
        if m[2]:
            if tag == "a":
                in_link = False
            if open_.get(tag):
                k = len(stack) - 1
                while stack[k][0] != tag and (tag in _BLOCK or stack[k][0] not in _BLOCK):
                    k -= 1
                if stack[k][0] == tag:
                    pop(k)
            continue
        if tag in _VOID:
            continue
        if tag == "a":
            # one that is not closed before the next begins is no link
            end = _LINK.search(page, at)
            in_link = end is not None and end[1] == "/"
        if tag in _ENDS_P and stack[-1][0] == "p" or tag == "li" and stack[-1][0] == "li":
            pop(len(stack) - 1)
        elif tag in _BLOCK and open_.get("p"):
            # a new block ends open inline elements and the paragraph around them
            k = len(stack) - 1
            while k > 0 and stack[k][0] not in _BLOCK:
                k -= 1
            if k > 0 and stack[k][0] == "p":
                pop(k)
        step, waste = _name(tag, m[4])
        _, path, skipped, mark = stack[-1]
        if waste:
            around.append(mark)
            mark = len(around) - 1
        articles += tag == "article" and not skipped
        if not skipped and (tag in _CONTENT or tag == "article" and articles == 1):
            up = mark
            while up not in content:
                content.add(up)
                up = around[up]
        stack.append((tag, paths.under(path, step) if tag in _CONTAINER else path, skipped or tag in _SKIP, mark))
        open_[tag] = open_.get(tag, 0) + 1
    if at < len(page):
        pieces.append(page[at:])
    flush()
    fine = [True]
    for mark in range(1, len(around)):  # what is around a marked element has a smaller number
        fine.append(mark in content and fine[around[mark]])
    kept = [b[:4] for b in out if fine[b[4]]]
    return paths, kept or [b[:4] for b in out]


def scores(paths: Paths, found: list[Block]) -> dict[int, float]:
    """Score of each container path: characters of its own blocks outside links, paragraphs in full, other blocks a quarter;
    half of them also count for the container around it. Where links leave no points, their characters count as well."""
    return _scores(paths, found, 2) or _scores(paths, found, 0)


def _scores(paths: Paths, found: list[Block], penalty: int) -> dict[int, float]:
    out: dict[int, float] = {}
    for path, text, linked, paragraph in found:
        worth = max(0, len(text) - penalty * linked) * (1.0 if paragraph else 0.25)
        worth *= 1.5 if paths.step[path].startswith(("article", "main")) else 1.0
        out[path] = out.get(path, 0.0) + worth
        around = paths.up[path]
        if around:
            out[around] = out.get(around, 0.0) + worth / 2
    return {p: x for p, x in out.items() if x > 0}


def main_text(paths: Paths, found: list[Block], path: int) -> str:
    """The blocks of the innermost article around the container at the path, else of main, else of the container."""
    chain = [path]
    while chain[-1]:
        chain.append(paths.up[chain[-1]])
    for kind in ("article", "main"):
        inner = next((p for p in chain if paths.step[p].partition(".")[0] == kind), None)
        if inner is not None:
            path = inner
            break
    inside = [p == path for p in range(len(paths.up))]
    for p in range(1, len(inside)):  # a path is numbered after the one around it
        inside[p] = inside[p] or inside[paths.up[p]]
    return "\n\n".join(text for at, text, _, _ in found if inside[at])


def _candidates(paths: Paths, points: dict[int, float]) -> list[tuple[str, int]]:
    """The paths that hold most of the best score, the best first, with their numbers."""
    top = max(points.values(), default=0.0)
    named = [(paths.text(p), p, x) for p, x in points.items() if x > top / 2]
    return [(text, p) for text, p, x in sorted(named, key=lambda c: (-c[2], -len(c[0]), c[0]))]


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for h in batch.column("html"):
            paths, parts = blocks(h.as_py() or "")
            found.append([text for text, _ in _candidates(paths, scores(paths, parts))])
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(found, pa.list_(pa.string()))], ["host", "candidates"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        candidates, texts = [], []
        for h in batch.column("html"):
            paths, found = blocks(h.as_py() or "")
            best = _candidates(paths, scores(paths, found))
            candidates.append([text for text, _ in best])
            texts.append([main_text(paths, found, p) for _, p in best])
        names = [n for n in batch.schema.names if n != "html"]
        arrays = [pa.array(x, pa.list_(pa.string())) for x in (candidates, texts)]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *arrays], [*names, "candidates", "texts"])


def host(url: str = "url") -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url).cast("string"), r"^\s*[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def choices(pages: DataFrame) -> DataFrame:
    """host, candidates, chosen (counted from 1) of the lists of candidates from which the votes choose another than the first."""
    found = cut(pages.select(host().alias("host"), F.col("html").cast("string")).mapInArrow(lean(_votes), "host string, candidates array<string>").where("size(candidates) > 0"))
    votes = found.groupBy("host", F.col("candidates")[0].alias("path")).agg(F.count("*").alias("votes"))
    open_ = found.where("size(candidates) > 1").distinct().select("host", "candidates", F.posexplode("candidates").alias("at", "path"))
    won = F.max_by(F.col("at") + 1, F.struct("votes", F.length("path"), -F.col("at"))).alias("chosen")
    return open_.join(votes, ["host", "path"]).groupBy("host", "candidates").agg(won).where("chosen > 1")


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, path of every row of pages (page_id, url, html).

    Null and empty html give an empty text; pages without a host in their url share the host ''. Repeated rows are
    extracted alike. Other columns are ignored."""
    chosen = cut(choices(pages))
    rows = pages.select("page_id", "url", F.col("html").cast("string"), host().alias("host"))
    kinds = dict(rows.dtypes)
    out = rows.mapInArrow(lean(_extract), f"page_id {kinds['page_id']}, url {kinds['url']}, host string, candidates array<string>, texts array<string>")
    if (n := chosen.count()) > 0:
        out = out.join(F.broadcast(chosen) if n <= BROADCAST_CHOICES else chosen, ["host", "candidates"], "left")
    else:
        out = out.withColumn("chosen", F.lit(1))
    at = F.coalesce("chosen", F.lit(1))
    text = F.coalesce(F.get("texts", at - 1), F.lit("")).alias("text")
    return out.select("page_id", "url", text, F.get("candidates", at - 1).alias("path")).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "path")
