"""Operator 3: main text of HTML pages by maximum-scoring subsequence."""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import slices, tidy

#: Labelled pages that weights are fitted on, at most, and blocks that must hold a tag or mark before it weighs anything.
FIT_PAGES, SUPPORT = 2000, 5
#: A word of plain text scores 1, in log-odds. Bounds of what a tag costs, and the cost of one that no labelled page has.
PLAIN, LEAST, MOST, UNSEEN = 1.0, 0.02, 0.7, 0.3
#: Bounds of what labelled pages may say for and against a mark, what standing outside a marked article says at most, and what all tags
#: between two blocks, or within one, cost at most.
INSIDE, OUTSIDE, ELSEWHERE, GAP = -6.0, 9.0, 3.0, 5.0

# Elements by their meaning in HTML.
RAW = ("script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe", "plaintext")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
BLOCKS = (
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend",
    "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead",
    "title", "tr", "ul",
)
# Elements whose text is no part of a page's running text.
NEVER = (
    "head", "form", "dialog", "script", "style", "noscript", "template", "button", "select", "option", "textarea", "label", "fieldset",
    "iframe", "object", "svg", "canvas", "audio", "video", "map", "noembed", "noframes", "title",
)
# Elements with a meaning of their own, and words in a class, id or role, for what an article is to be cut free of:
# menus, headers, footers, sidebars and notices;
LANDMARKS = ("nav", "menu", "header", "footer", "aside")
NAMED = ("nav", "navbar", "navigation", "menu", "header", "masthead", "banner", "footer", "sidebar", "aside", "notice", "notification", "cookie", "cookies", "consent", "hidden")
# adverts and reader comments, which interrupt even an article that is marked as such.
INTERRUPTS = ("ad", "ads", "advert", "adverts", "advertisement", "sponsored", "promo", "comment", "comments", "replies")
#: As many blocks outside an article are thought to have been seen with each of them before any page is: where labelled pages are
#: silent that decides, and what they have counts beside it.
BELIEVED = 50
#: Log-odds from which a block within the best run is left out by itself; under it, the scan alone decides.
SURE = 2.0
#: Elements that an opening tag of one of the others ends.
ENDS = {"p": frozenset(BLOCKS), "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option"}, "head": {"body"}}

_BLOCKS, _VOID, _NEVER, _RAW = map(frozenset, (BLOCKS, VOID, NEVER, RAW))
_INTERRUPTS = frozenset("." + w for w in INTERRUPTS)
_BELIEVED = _INTERRUPTS | {"." + w for w in NAMED} | {*LANDMARKS}
_MARKED = frozenset({*LANDMARKS, "article", "main"})
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)>|</?[a-zA-Z][^<>]*+\Z""",
    re.S,
)
_SAID = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PART, _SPACE = re.compile(r"[a-z]+"), re.compile(r"\s+")


@dataclass
class Block:
    """A run of text between block borders; marks: what the elements around it say; before, inside: the tags since the block before it,
    and those within it."""

    text: str
    marks: frozenset[str]
    before: list[str]
    inside: list[str]

    @property
    def in_article(self) -> bool:
        return "article" in self.marks or "main" in self.marks

    @property
    def dropped(self) -> bool:
        return "!" in self.marks


@dataclass(frozen=True)
class Weights:
    """What labelled pages teach: tags' costs; marks' log-odds of standing outside the article (without a mark: -PLAIN)."""

    tags: dict[str, float]
    marks: dict[str, float]

    def odds(self, block: Block, elsewhere: bool) -> float:
        """Log-odds that a word of the block is no content. elsewhere: the page marks an article, and the block is not in it. What
        interrupts articles does so whatever stands around it."""
        said = [self.marks.get(m, 0.0) for m in block.marks]
        if any(self.marks.get(m, 0.0) > 0 for m in block.marks & _INTERRUPTS):
            said = [max(0.0, x) for x in said]
        return sum(said) + (self.marks.get("~", 0.0) if elsewhere else 0.0) - PLAIN

    def cost(self, tags: list[str]) -> float:
        return min(GAP, sum(self.tags.get(t, UNSEEN) for t in tags))


def _marks(name: str, attributes: str) -> frozenset[str]:
    """The marks of an element: its name, if that has a meaning; a dot and each word of its class, id and role; ! if it never counts."""
    out = {name} if name in _MARKED else {"!"} if name in _NEVER else set()
    if attributes and name not in ("html", "body"):
        words = {w for m in _SAID.findall(attributes) for w in _PART.findall("".join(m).lower())}
        out |= {"." + w for w in words}
        if _HIDDEN.search(attributes):
            out.add(".hidden")
    return frozenset(out)


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, in one scan. Unclosed and misnested tags end where HTML lets them end."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []  # block and marked elements: name, all marks from the page down to it
    text: list[str] = []
    before: list[str] = []
    inside: list[str] = []
    started = False
    at, size = 0, len(page)

    def flush() -> None:
        nonlocal started, before, inside
        if started:
            joined = _SPACE.sub(" ", references.unescape("".join(text))).strip()
            if joined:
                out.append(Block(joined, stack[-1][1] if stack else frozenset(), before, inside))
                before, inside = [], []
            else:
                before, inside = before + inside, []
        text.clear()
        started = False

    while at < size:
        m = _TOKEN.search(page, at)
        piece = page[at : m.start() if m else size]
        if piece:
            text.append(piece)
            started = started or not piece.isspace()
        if m is None:
            break
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if m["end"] or m["end2"]:
            found = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None) if name in _BLOCKS or stack and any(x[0] == name for x in stack[-8:]) else None
            if name in _BLOCKS or found is not None:
                flush()
            if found is not None:
                del stack[found:]
            (inside if started else before).append("/" + name)
            continue
        rest = m["rest"] if m["rest"] is not None else m["rest2"]
        marks = _marks(name, rest)
        parts = name in _BLOCKS or "!" in marks or not marks.isdisjoint(_BELIEVED)  # what begins a block of its own
        if parts:
            flush()
            while stack and name in ENDS.get(stack[-1][0], ()):
                stack.pop()
        (inside if started else before).append(name)
        if name in _RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = close.end() if close else size
        elif name == "br":
            text.append(" ")
        elif name not in _VOID and not rest.endswith("/") and parts:
            around = stack[-1][1] if stack else frozenset()
            if name in ("article", "main"):  # an article in an article has marks of its own that count afresh
                around = around - {"article", "main"}
            stack.append((name, around | marks))
    flush()
    return out


def weights(counts: Counter, labelled: Counter) -> Weights:
    """Log-odds of standing outside the content, from counts of (inside, tag or mark) and the numbers of blocks in and outside, and from
    what is believed before."""
    total = {side: labelled[side] + 1 for side in (True, False)}
    odds = {}
    for k in {t for _, t in counts} | _BELIEVED:
        n_in, n_out = counts[True, k], counts[False, k] + BELIEVED * (k in _BELIEVED)
        if n_in + n_out >= SUPPORT:
            odds[k] = math.log((n_out + 0.5) / total[False]) - math.log((n_in + 0.5) / total[True])
    tags = {k[1:]: min(MOST, max(LEAST, v)) for k, v in odds.items() if k[0] == "<"}
    return Weights(tags, {k: min(ELSEWHERE if k == "~" else OUTSIDE, max(INSIDE, v)) for k, v in odds.items() if k[0] != "<"})


def scores(found: list[Block], w: Weights) -> list[tuple[float, float]]:
    """For each block what the tags before it cost, and what its words less the tags within score. Every word scores its block's log-odds
    of being content. Blocks that are surely no content cost PLAIN whatever their length: an advert must not cut an article in two,
    and they are left out of the text in any case. Inside a marked article tags cost LEAST, for there they say nothing more."""
    marked, out = any(b.in_article and not b.dropped for b in found), []
    for b in found:
        odds = w.odds(b, marked and not b.in_article)
        decided = b.in_article and odds < 0
        gap = min(GAP, LEAST * len(b.before)) if decided else w.cost(b.before)
        inner = min(1.0, LEAST * len(b.inside)) if decided else w.cost(b.inside)
        n = b.text.count(" ") + 1
        out.append((gap, -PLAIN if b.dropped or odds >= SURE else -odds * n - inner))
    return out


def best_run(scored: list[tuple[float, float]]) -> tuple[int, int]:
    """The run of blocks of highest sum, the gaps inside it included, in one scan; ties: the earliest, then the shortest."""
    best, best_range, running, start = 0.0, (0, 0), 0.0, 0
    for i, (gap, score) in enumerate(scored):
        running -= gap
        if running <= 0:
            running, start = 0.0, i
        running += score
        if running > best:
            best, best_range = running, (start, i + 1)
    return best_range


def main_text(page: str, w: Weights) -> str:
    """The contiguous run of blocks whose words less tags score highest, without the blocks in it that are surely no content."""
    found = blocks(page)
    marked = any(b.in_article and not b.dropped for b in found)
    return "\n".join(b.text for b in found[slice(*best_run(scores(found, w)))] if not b.dropped and w.odds(b, marked and not b.in_article) < SURE)


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", seed: int = 7, most: int = FIT_PAGES) -> Weights:
    """Weights from at most `most` labelled pages: pages that mark their article with an element of its own (article, main), those of
    smallest seeded hash of the id. A block is content if it stands in that element and nothing that interrupts articles is around it.
    Tags and marks of fewer than SUPPORT blocks weigh nothing. Without any labelled page there is only what is BELIEVED, and every tag
    costs UNSEEN."""

    def count(batches):
        for batch in batches:
            seen = Counter()
            for page in batch.column("html").to_pylist():
                found = blocks(page)
                if any(b.in_article for b in found):
                    for b in found:
                        where = b.in_article and not b.dropped and b.marks.isdisjoint(_INTERRUPTS)
                        seen.update((where, k) for k in {"", *("<" + t for t in b.before + b.inside), *b.marks, *(() if b.in_article else ("~",))})
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.bool_()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["inside", "tag", "n"])

    ids = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).cast("string").alias("html"))
    labelled = ids.where(F.col("html").rlike("(?i)<(article|main)[\\s>]")).select("id").where("id is not null").distinct()
    chosen = labelled.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(most)  # a bounded number of ids
    rows = ids.join(F.broadcast(chosen), "id", "left_semi").select("html").mapInArrow(tidy(count), "inside boolean, tag string, n long")
    sums = rows.groupBy("tag", "inside").agg(F.sum("n").alias("n"))
    kept = sums.withColumn("of", F.sum("n").over(Window.partitionBy("tag"))).where(F.col("of") >= SUPPORT).collect()  # of a bounded sample of pages
    counts = Counter({(r["inside"], r["tag"]): r["n"] for r in kept if r["tag"]})
    return weights(counts, Counter({r["inside"]: r["n"] for r in kept if not r["tag"]}))


def extract(pages: DataFrame, w: Weights, html_col: str = "html", keep: tuple[str, ...] = (), name: str = "text") -> DataFrame:
    """keep's columns of pages, the main text of html_col as name, and n_chars, its number of code points.

    Null and empty pages, and pages without words, get the empty text. Pages are scanned whole, in time linear in their length for
    tags that nest to a bounded depth. Of runs that score alike the earliest is taken. One narrow pass, no shuffle; repeated rows come
    out repeated. Columns of pages other than keep and html_col aren't read, of whatever name; keep must not hold name or n_chars
    (ValueError).
    """
    if clash := {name, "n_chars"} & {*keep}:
        raise ValueError(f"keep must not hold {sorted(clash)}")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "__html"):
                texts = [main_text(p, w) if p else "" for p in part.column("__html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*keep, name, "n_chars"])

    rows = pages.select(*keep, F.col(html_col).cast("string").alias("__html"))
    schema = "".join(f"`{c}` {t}, " for c, t in rows.dtypes[:-1]) + f"`{name}` string, n_chars long"
    return rows.mapInArrow(tidy(run), schema)
