"""Main text of web pages by two passes over blocks.

Pass one reads the markup into blocks and scores each: its share of stop words, trusted in
proportion to its length, against its share of linked text. Markup is one feature of the score: an
article or main element raises it, standing outside of the page's article lowers it. A block with a
high score is good, one with a low score bad; short and middling ones are left open. Pass two gives
the open blocks the label of their nearest decided neighbours, where nearest means: in the smallest
common element, then in page order. A page without any good block is its unlinked open blocks.

What declares itself to be no text of the article (menus, headers of the page, footers, sidebars,
forms, buttons, scripts, adverts, notices, comments of readers) is taken out before and has no say.

White space inside a block becomes one space, blocks are joined by one space in page order.

Cases: null or empty markup gives an empty text. Unclosed and misnested elements are closed as
HTML does for paragraphs, list items and table cells; a quote in a tag that is not closed properly
ends with its tag; markup that breaks off in a tag ends there. Repeated rows give repeated results.
Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Common short words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a an and are as at be by for from has have he in is it its not of on or that the this to was were which with "
    "aber als am auch auf aus bei das dem den der des die ein eine er es für ich im in ist mit nicht sich sie und von zu zum "
    "au aux avec ce ces dans de des du elle en est et il je la le les ne on ou par pas pour qui que se son sur un une "
    "al como con de del el ella en es la las lo los no o para pero por que se su un una y".split()
)
#: The score of a block: KEEN for each share of stop words above USUAL, within the bounds LEAN, in
#: full for SURE characters or more; LINK for a block of links alone; INSIDE the article, in the main
#: element BESIDE it, and OUTSIDE of both.
KEEN, USUAL, LEAN, SURE = 8.0, 0.2, (-0.7, 2.0), 140
LINK, INSIDE, BESIDE, OUTSIDE = -3.0, 1.0, -2.0, -4.0
GOOD, BAD = 0.6, -0.8
#: Below this length an open block is short and goes with the bad side where its neighbours differ.
SHORT = 70

RAW = frozenset("script style textarea title noscript iframe template svg math canvas object select".split())
#: Skipped up to their end where it exists; the tags alone otherwise.
MUTE = frozenset("button datalist".split())
CHROME = frozenset("nav header footer aside form dialog menu fieldset label input".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: A class or id names chrome as a whole, or with its first or last part: ad-slot, cookie_notice.
MARK = (
    r"(?:ad|ads|adv|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|nav|navbar|navigation|menu|breadcrumbs?|footer|sidebar|side-?bar|widget|related|share|sharing|social|"
    r"cookies?|consent|gdpr|notice|notices|popup|pop-?up|modal|overlay|newsletter|subscribe|signup|login|comments?|commentlist|disqus|replies|reply|pagination|pager|masthead|skip|toolbar|copyright|hidden)"
)
MARKS = re.compile(rf"(?:^|\s){MARK}(?:[\s_-]|$)|(?:^|[\s_-]){MARK}(?:\s|$)", re.I)
#: What a class must say of a frame (an article, the main part) for it not to be the page's own.
REPLIES = re.compile(r"(?:^|[\s_-])(?:comments?|replies|reply)(?:$|[\s_-])", re.I)
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that close an open element of these names.
CLOSES = {n: {"p"} for n in BLOCKS - {"br", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "html", "body", "option"}} | {
    "li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, "tr": {"p", "tr", "td", "th"}, "td": {"p", "td", "th"}, "th": {"p", "td", "th"}, "option": {"option"},
}
#: Elements beyond which an implied end does not reach.
SCOPE = frozenset("html body div section article main table td th ul ol dl nav header footer aside form blockquote figure".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
    # quotes that close before a space, slash or the end of the tag; or else what comes up to the first >
    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"(?=[\s/>])|'[^']*+'(?=[\s/>]))*+|[^>]*)(>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACE = re.compile(r"\s+")
FRAME = frozenset(["article", "main"])


#: Elements that hold one block each, and are no neighbourhood of their own.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre caption summary figcaption".split())
LETTERS = re.compile(r"[^\W\d_]+")


class Block:
    """A run of text between block boundaries; `shared` is the depth of the smallest element that holds it and the block before."""

    __slots__ = ("chrome", "framed", "head", "label", "linked", "parts", "shared")

    def __init__(self, chrome: bool, framed: int, head: bool, shared: int):
        self.parts: list[str] = []
        self.linked = 0
        self.chrome, self.framed, self.head, self.shared, self.label = chrome, framed, head, shared, ""


def _is_chrome(name: str, attributes: str, framed: bool) -> bool:
    if name in CHROME and not (framed and name == "header"):
        return True
    if not attributes or name in ("html", "body"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id") and (REPLIES if name in FRAME else MARKS).search(value) or key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


def read_blocks(markup: str) -> list[Block]:
    blocks: list[Block] = []
    stack: list[tuple[str, bool, int, int]] = []  # name, in chrome, in a frame (1 main, 2 article), depth of containers
    block: Block | None = None
    links = shared = 0
    unclosed: set[str] = set()
    at, end = 0, len(markup)

    def put(text: str) -> None:
        nonlocal block, shared
        if not text:
            return
        if block is None:
            if not text.strip():
                return
            chrome, framed, depth = stack[-1][1:] if stack else (False, 0, 0)
            block = Block(chrome, framed, any(n[0] == "h" and n[1:].isdigit() for n, *_ in stack), min(shared, depth))
            shared = depth
            blocks.append(block)
        text = html.unescape(text)
        block.parts.append(text)
        if links:
            block.linked += len(text.strip())

    def shut(k: int) -> None:
        nonlocal shared
        del stack[k:]
        shared = min(shared, stack[-1][3] if stack else 0)

    while at < end:
        m = TOKEN.search(markup, at)
        if m is None:
            put(markup[at:])
            break
        put(markup[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            if name in BLOCKS:
                block = None
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if any(stack[i][1] != (stack[k - 1][1] if k else False) for i in range(k, len(stack))):
                        block = None
                    shut(k)
                    break
                if name not in SCOPE and stack[k][0] in SCOPE:
                    break
            continue
        if not m[4]:
            break  # the page broke off inside a tag
        if name in RAW or name in MUTE:
            if not m[3].rstrip().endswith("/"):
                close = None if name in unclosed else re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)", re.I).search(markup, at)
                if close is None:
                    unclosed.add(name)
                at = close.end() if close else at if name == "title" or name in MUTE else end
            continue
        if name in ("head", "option", "optgroup"):
            continue
        if name in BLOCKS:
            block = None
            closes = CLOSES.get(name)
            if closes:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in closes:
                        shut(k)
                        break
                    if stack[k][0] in SCOPE:
                        break
        if name in VOID:
            continue
        chrome, framed, depth = stack[-1][1:] if stack else (False, 0, 0)
        own = chrome or _is_chrome(name, m[3], framed > 0)
        if own and not chrome:
            block = None
        if name == "a":
            links = 1
        framed = 2 if name == "article" else max(framed, 1) if name == "main" else framed
        stack.append((name, own, framed, depth + (name in BLOCKS and name not in LEAVES)))
    return blocks


def score(block: Block, text: str, frame: int) -> float:
    """Pass one's score; `frame` is the kind of frame that the page has."""
    words = LETTERS.findall(text.lower())
    stops = sum(map(STOP_WORDS.__contains__, words)) / max(1, len(words))
    prose = min(max(KEEN * (stops - USUAL), LEAN[0]), LEAN[1]) * min(1.0, len(text) / SURE)
    place = 0.0 if not frame else INSIDE if block.framed == frame else BESIDE if block.framed else OUTSIDE
    return prose + LINK * min(1.0, block.linked / max(1, len(text))) + place


def _carried(blocks: list[Block], up: list[int]) -> list[tuple[str, int]]:
    """For each block the last decided label before it, and the depth of the element they share; up[i] is shared by i - 1 and i."""
    out, last, depth = [], "", -1
    for b, shared in zip(blocks, up, strict=True):
        depth = min(depth, shared)
        out.append((last, depth))
        if b.label in ("good", "bad"):
            last, depth = b.label, 1 << 30
    return out


def classify(blocks: list[tuple[Block, str]]) -> None:
    """Both passes; blocks are paired with their clean text. Chrome is bad and not asked."""
    asked, shared = [], []
    low = 1 << 30
    for b, text in blocks:
        low = min(low, b.shared)
        if b.chrome:
            b.label = "bad"
        else:
            asked.append((b, text))
            shared.append(low)
            low = 1 << 30
    frame = max((b.framed for b, _ in asked), default=0)
    for b, text in asked:
        value = score(b, text, frame)
        b.label = "good" if value >= GOOD else "short" if len(text) < SHORT else "near"
        if value <= BAD and not (frame and b.framed == frame):
            b.label = "bad"
    some = any(b.label == "good" for b, _ in asked)
    own = [b for b, _ in asked]
    before = _carried(own, shared)
    after = _carried(own[::-1], [0, *shared[:0:-1]][: len(own)])[::-1]
    for (b, text), (x, dx), (y, dy) in zip(asked, before, after, strict=True):
        if b.label not in ("short", "near"):
            continue
        if frame and b.framed == frame:  # only blocks of the article are its neighbours, and none of them is bad
            b.label = "good"
        elif not some:
            b.label = "good" if 2 * b.linked <= len(text) else "bad"
        elif x == y or x and dx > dy or y and dy > dx:
            b.label = x if x == y or x and dx > dy else y
        else:
            b.label = "good" if b.label == "near" or b.head and y == "good" else "bad"


def main_text(markup: str | None) -> str:
    blocks = [(b, text) for b in read_blocks(markup or "") if (text := SPACE.sub(" ", "".join(b.parts)).strip())]
    classify(blocks)
    return " ".join(text for b, text in blocks if b.label == "good")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for each row of `pages`."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_extract, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
