"""Main text of web pages by two passes of block rules.

A page is read tag by tag into blocks of text, each with the number of its characters in links and
the containers around it. Menus, headers, footers, sidebars, notices, adverts, forms, comments,
scripts and hidden parts are left out by their tags and by the words of their class, id and role.

The first pass classifies every block on its own. Much text in links or a copyright sign makes it
bad. A long block of many stop words is good, a shorter one near good; a long block of few stop
words is bad; the rest is short. The second pass settles what is near good or short by the nearest
decided blocks before and after: like labels are taken over, between unlike ones a near good block
is good and a short one follows the nearer (the earlier one at equal distance). Where no block is
good, the near good ones are.

Where the page marks its article (``article``, else ``main``), only what is inside counts: there
length and stop words decide nothing, and the ends of the article count as good neighbours. Without
such a mark the ends of the page count as bad.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed
and joined in page order. Null, empty and text-free pages give the empty text. Pages are read whole
and cut nowhere; unclosed tags end with their container, repeated rows give equal results.
"""

import html as references
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figmill.llm.batches import slices

LINKED = 0.5
SHORT = 70
LONG = 200
STOPS_LOW = 0.15
STOPS_HIGH = 0.25

# Frequent words of the four languages.
STOP_WORDS = frozenset(
    """
    the of and to in a is that it he was for on are as with his they i at be this have from or one
    had by but not what all were we when your can said there an each which she do how their if will
    de la le et les des en un une du que qui dans est pour pas sur au plus par il ne se ce avec son
    elle je nous vous mais ou sont aux cette
    der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an
    werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über
    el los las que y una del al lo como más o pero sus le ha me si sin sobre este ya entre cuando
    todo esta ser son dos también fue era muy
    """.split()
)

# Tags by what they mean for the text.
RAW = frozenset("script style textarea title noscript template iframe svg math xmp".split())
LEFT_OUT = frozenset(
    "head nav footer aside form button select option menu dialog fieldset object embed audio video "
    "canvas map".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol "
    "option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag that ends an open element of these names when it is the innermost block.
CLOSES = {
    "li": {"li", "p"},
    "dt": {"dt", "dd", "p"},
    "dd": {"dt", "dd", "p"},
    "tr": {"td", "th", "tr", "p"},
    "td": {"td", "th", "p"},
    "th": {"td", "th", "p"},
    "option": {"option"},
}
# Words of class, id and role that mark what is not the article.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment "
    "comments complementary contentinfo cookie cookies consent dialog disqus footer gdpr header "
    "hidden login masthead menu modal nav navbar navigation newsletter notice notices pager "
    "pagination popup promo promoted promotion recommended related replies reply search share "
    "sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar "
    "topbar widget widgets adsense discussion respond alert".split()
)
#: Of these, the ones that also mark an article or section as not the main one.
FOREIGN = frozenset(
    "ad ads advert advertisement comment comments promo promoted recommended related replies reply "
    "sponsor sponsored teaser discussion respond".split()
)

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(
    r"(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?",
    re.I,
)
WORDS = re.compile(r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])|[a-z]+")
LETTERS = re.compile(r"[^\W\d_]+")


class Block:
    """Text of one block: pieces, characters in links, in an article, in a main element."""

    __slots__ = ("pieces", "linked", "article", "main")

    def __init__(self, article: bool, main: bool):
        self.pieces, self.linked, self.article, self.main = [], 0, article, main

    def text(self) -> str:
        return " ".join(references.unescape("".join(self.pieces)).split())


def left_out(tag: str, attributes: str) -> bool:
    """Do the tag's own attributes say that it is not the article?"""
    if not attributes or tag in ("html", "body", "main"):
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
            continue
        words = {w.lower() for w in WORDS.findall(value)}
        if words & (FOREIGN if tag in ("article", "section") else HINTS):
            return True
    return False


def blocks(page: str) -> list[Block]:
    """Blocks of text outside of what is left out, in page order."""
    out: list[Block] = []
    # Open elements: name, left out by tag, left out by hint, in article, in main, in a link.
    stack: list[tuple[str, bool, bool, bool, bool, bool]] = []
    state = ("", False, False, False, False, False)
    block: Block | None = None
    at = 0

    def add(text: str):
        nonlocal block
        _, tag_out, hint_out, article, main, link = state
        if tag_out or hint_out or not text:
            return
        if block is None:
            if text.isspace():
                return
            block = Block(article, main)
            out.append(block)
        block.pieces.append(text)
        if link:
            block.linked += len(text.strip())

    def pop_to(depth: int):
        nonlocal state
        del stack[depth:]
        state = stack[-1] if stack else ("", False, False, False, False, False)

    while True:
        found = TAG.search(page, at)
        add(page[at : found.start()] if found else page[at:])
        if not found:
            return out
        at = found.end()
        closing, name, attributes = found.groups()
        if name is None:
            continue
        name = name.lower()
        if name in BLOCKS:
            block = None
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    pop_to(depth)
                    break
            continue
        if name in RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        closes = CLOSES.get(name, {"p"} if name in BLOCKS else ())
        while stack and closes:
            inner = next((d for d in range(len(stack) - 1, -1, -1) if stack[d][0] in BLOCKS), None)
            if inner is None or stack[inner][0] not in closes:
                break
            pop_to(inner)
        _, tag_out, hint_out, article, main, link = state
        if name in ("article", "main"):
            hint_out = False  # a hint on a wrapper of the whole page
        article, main = article or name == "article", main or name == "main"
        tag_out = tag_out or name in LEFT_OUT or (name == "header" and not article)
        hint_out = hint_out or left_out(name, attributes)
        state = (name, tag_out, hint_out, article, main, link or name == "a")
        stack.append(state)


def first_pass(text: str, linked: int, inside: bool) -> str:
    """Label of a block on its own."""
    if linked > LINKED * len(text) or (text.startswith("©") and not inside):
        return "bad"
    if inside:
        return "good" if len(text) >= SHORT and not linked else "near"
    words = LETTERS.findall(text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(len(words), 1)
    if len(text) < SHORT:
        return "short"
    if stops >= STOPS_HIGH:
        return "good" if len(text) >= LONG else "near"
    return "near" if stops >= STOPS_LOW else "bad"


def second_pass(labels: list[str], edge: str) -> list[str]:
    """Settle near good and short blocks by their nearest decided neighbours."""
    if "good" not in labels:
        labels = ["good" if label == "near" else label for label in labels]
    decided = [n for n, label in enumerate(labels) if label in ("good", "bad")]
    out, following = list(labels), 0
    for n, label in enumerate(labels):
        while following < len(decided) and decided[following] < n:
            following += 1
        if label in ("good", "bad"):
            continue
        before = decided[following - 1] if following else -1
        after = decided[following] if following < len(decided) else len(labels)
        left = labels[before] if before >= 0 else edge
        right = labels[after] if after < len(labels) else edge
        if left == right:
            out[n] = left
        elif label == "near":
            out[n] = "good"
        else:
            out[n] = left if n - before <= after - n else right
    return out


def main_text(page: str) -> str:
    """The main text of a page."""
    read = [(b, b.text()) for b in blocks(page)]
    read = [(b, t) for b, t in read if t]
    marked = [(b, t) for b, t in read if b.article] or [(b, t) for b, t in read if b.main]
    inside = bool(marked)
    chosen = marked or read
    labels = [first_pass(t, b.linked, inside) for b, t in chosen]
    settled = second_pass(labels, "good" if inside else "bad")
    return " ".join(t for (_, t), label in zip(chosen, settled, strict=True) if label == "good")


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the column ``text``, the main text of ``html``."""
    kept = pages.drop(text) if text != html else pages
    schema = kept.withColumn(text, F.lit(None).cast("string")).schema

    def work(batches):
        for part in slices(batches, html):
            texts = [main_text(page) for page in pc.fill_null(part.column(html), "").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, text]
            )

    return kept.mapInArrow(work, schema)
