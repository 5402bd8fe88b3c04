"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Structure only rejects: blocks inside a part that is never main text (menu, header,
footer, sidebar, form, script, comment section, ...) are out before both passes. First pass: link density, length and stop-word density make every
other block, inside an article element or not, *good*, *bad* or, where it is too short to tell, long without links and stop words, or a heading or paragraph of an article that is mostly links, *undecided*. Second pass: an undecided block takes the label of the nearest
decided one: among the blocks of its own article or main element, if any of these is decided; else among all of the page, where
rejected ones count as bad. Equally near ones that differ make it bad.

On a page where no block is good by its density, stop words tell nothing (another language, or short blocks alone): there blocks that are no links are good.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by a line feed in
page order. Null and empty pages have no text. A page without any tag is one block, decoded and trimmed alike, and kept. Nothing is capped. Rows that
repeat a page are extracted each on its own; extra columns pass through, but for those named ``text`` or ``n_chars``, which the results replace.
"""

from __future__ import annotations

import html
import re
import string
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z|[\"'][^>]*(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: Elements whose content is text that is never shown, up to their own end tag.
RAW = frozenset("script style noscript template textarea svg math iframe object title".split())
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
#: Elements that are never part of the article.
AWAY = frozenset("head nav header footer aside form button select dialog menu".split())
#: Elements that end the block before them and start one.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose end is implied by the next of their kind or by a block.
OPEN_ENDED = frozenset("p li dt dd tr td th option".split())
REGION = frozenset("article main".split())
#: Elements of an article whose text may be a link as a whole.
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p".split())
#: Words that name, in a class, id or role, what is around an article.
AROUND = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos promotion promoted banner banners cookie cookies consent gdpr notice notices alert alerts"
    " popup popups modal overlay nav navbar navigation menu menus menubar submenu breadcrumb breadcrumbs sidebar sidebars side widget widgets footer header masthead topbar respond response responses reply replies"
    " disqus discussion discussions related recommended recommendation recommendations share shares sharing social newsletter newsletters subscribe subscription signup signin login"
    " search searchbox searchform pagination pager toolbar complementary contentinfo legal copyright skip skiplink comment comments commentlist dialog".split()
)
#: Words that may stand beside them in such a name and change nothing.
BESIDE = frozenset(
    "list area box bar wrapper wrap container holder button buttons link links block blocks section site page global top bottom left right primary secondary tertiary item items inner outer"
    " content text title form column col row group panel wide main article post posts entry story body the and of id field icon icons message".split()
)
#: Words of which a name of the article itself consists; one such name outweighs the list above, but for comments.
ITSELF = frozenset("article main content post entry story body text".split())
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond response responses".split())
EDGES = string.punctuation + "\u00ab\u00bb\u201c\u201d\u201e\u2018\u2019\u2026\u00bf\u00a1"
#: Common words of the four languages of the corpus; densities are over all of them.
STOP_WORDS = frozenset(
    "the of and to in a is that it for on with as was be by at this are or an from not but have he she they his her which you we"
    " der die das und in zu den von mit ist im für auf des ein eine nicht als auch dem an es sich sind wird"
    " le la les de des et un une en que qui dans pour par sur au aux est pas avec ce il elle du"
    " el los las y del que por para con una su al lo como más pero sus se no".split()
)
LONG_CHARS = 140
SHORT_CHARS = 60
LINK_DENSITY = 0.4
SOME_LINKS = 0.1
STOP_HIGH = 0.25
STOP_LOW = 0.08
GOOD, BAD, UNDECIDED = 1, 0, -1


def named_words(value: str) -> list[list[str]]:
    """The words of each name in a class, id or role value: parts between hyphens, underscores, digits and capitals."""
    return [re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) for name in value.split()]


def around(attributes: str, in_region: bool = False) -> bool:
    """Whether class, id, role or a hidden mark tell that an element stands beside the article. An article's own header holds its title."""
    if "=" not in attributes and "hidden" not in attributes.lower():
        return False
    named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", re.sub(r"=\s*(?:\"[^\"]*\"|'[^']*')", "=x", attributes), re.I) or named.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", named.get("style", "")):
        return True
    names = [words for k in ("class", "id", "role") for words in named_words(named.get(k, "")) if words]
    tells = AROUND - {"header"} if in_region else AROUND
    told = [words for words in names if any(w in tells for w in words) and all(w in AROUND or w in BESIDE for w in words)]
    if any(w in COMMENTS for words in told for w in words):
        return True
    return bool(told) and not any(all(w in ITSELF for w in words) for words in names)


class Block(NamedTuple):
    text: str
    #: Characters in links.
    linked: int
    #: Inside a structural part that is no main text.
    rejected: bool
    #: Number of the innermost article or main element around it, 0 for none.
    region: int
    #: A heading or paragraph of an article or main element.
    prose: bool = False


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order."""
    found: list[Block] = []
    pieces: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, int]] = []  # open block elements; whether each is away from the article; its region
    opened: Counter[str] = Counter()  # open elements by name: an end tag of none is passed over without a search
    away = links = regions = skipped = 0
    skip = ""  # an inline element beside the article, and how many of its name are open in it

    def flush() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(p for p, _ in pieces)).split())
            if text:
                linked = sum(len(" ".join(html.unescape(p).split())) for p, is_link in pieces if is_link)
                found.append(Block(text, linked, away > 0, stack[-1][2] if stack else 0, bool(stack) and stack[-1][2] > 0 and stack[-1][0] in PROSE))
            pieces.clear()

    def add(text: str) -> None:
        if not skipped:
            pieces.append((text, links > 0))

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None or m.start() > at:
            add(page[at : m.start() if m else end])
        if m is None:
            break
        at = max(m.end(), m.start() + 1)
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                add(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        closing, name = bool(m[1]), m[2].lower()
        empty = name in VOID or m[3].endswith("/")
        if name in RAW and not closing:
            if not m[3].endswith("/"):
                stop = RAW_END[name].search(page, at)
                at = stop.end() if stop else end
            if name not in ("svg", "math", "title"):
                add(" ")
            continue
        if name == "a":
            links = 0 if closing else 1
            continue
        if name == "br":
            add(" ")
            continue
        if name not in BLOCK:
            if skipped and name == skip and not empty:
                skipped += -1 if closing else 1
            elif not skipped and not closing and not empty and around(m[3]):
                skip, skipped = name, 1
            continue
        flush()
        links = skipped = 0  # inline elements end with their block
        region = stack[-1][2] if stack else 0
        if closing:
            last = None
            while opened[name] and last != name:
                last, beside, _ = stack.pop()
                away -= beside
                opened[last] -= 1
        elif not empty:
            if stack and (stack[-1][0] == "p" or (name in OPEN_ENDED and stack[-1][0] == name)):
                last, beside, _ = stack.pop()
                away -= beside
                opened[last] -= 1
            # a page's body or article is never beside itself
            beside = (name in AWAY and not (name == "header" and region)) or (name not in ("html", "body", "article", "main") and around(m[3], region > 0))
            if name in REGION:
                regions += 1
                region = regions
            stack.append((name, beside, region))
            opened[name] += 1
            away += beside
    flush()
    return found


def first_label(block: Block) -> int:
    """The label of a block by its own links, length and stop words."""
    text = block.text
    if block.linked > LINK_DENSITY * len(text):
        return UNDECIDED if block.prose else BAD
    if len(text) < SHORT_CHARS:
        return UNDECIDED
    tokens = [w.strip(EDGES).lower() for w in text.split()]
    density = sum(w in STOP_WORDS for w in tokens) / len(tokens)
    if density >= (STOP_LOW if len(text) >= LONG_CHARS else STOP_HIGH):
        return GOOD
    # long, with links and without stop words: a list of links; without links it may as well be a table or another language
    return BAD if len(text) >= LONG_CHARS and density < STOP_LOW and block.linked > SOME_LINKS * len(text) else UNDECIDED


def nearest(labels: list[int], otherwise: int) -> list[int]:
    """Each undecided label becomes that of the nearest decided one, bad where equally near ones differ, ``otherwise`` where there is none."""
    n = len(labels)
    far = (n + 1, otherwise)
    before, after = [far] * n, [far] * n
    for order, out in ((range(n), before), (range(n - 1, -1, -1), after)):
        last = None
        for i in order:
            if labels[i] != UNDECIDED:
                last = i
            elif last is not None:
                out[i] = (abs(i - last), labels[last])
    return [label if label != UNDECIDED else min(a[1], b[1]) if a[0] == b[0] else min(a, b)[1] for label, a, b in zip(labels, before, after, strict=True)]


def second_labels(found: list[Block], labels: list[int]) -> list[int]:
    """The labels after inheritance: in the block's own region, then over the page; rejected blocks stay bad."""
    labels = [BAD if b.rejected else x for b, x in zip(found, labels, strict=True)]
    own: dict[int, list[int]] = {}
    for i, b in enumerate(found):
        if b.region and not b.rejected:
            own.setdefault(b.region, []).append(i)
    for places in own.values():
        for i, x in zip(places, nearest([labels[i] for i in places], UNDECIDED), strict=True):
            labels[i] = x
    return nearest(labels, BAD)


def kept_blocks(found: list[Block]) -> list[bool]:
    """Which blocks are main text."""
    labels = [first_label(b) for b in found]
    if not any(x == GOOD and not b.rejected for b, x in zip(found, labels, strict=True)):
        return [not b.rejected and b.linked <= LINK_DENSITY * len(b.text) for b in found]
    return [x == GOOD for x in second_labels(found, labels)]


def main_text(page: str | None) -> str:
    """The kept blocks of one page."""
    if not page:
        return ""
    if "<" not in page:
        return " ".join(html.unescape(page).split())
    found = blocks(page)
    return "\n".join(b.text for b, x in zip(found, kept_blocks(found), strict=True) if x)


def html_extract(pages: DataFrame) -> DataFrame:
    """``pages(html, ...)`` without the html, with ``text`` and ``n_chars`` (code points)."""
    others = [c for c in pages.columns if c.lower() not in ("html", "text", "n_chars")]
    schema = T.StructType([pages.schema[c] for c in others] + [T.StructField("text", T.StringType())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(p) for p in batch.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + [texts], [*others, "text"])

    done = pages.select(*others, "html").mapInArrow(extract, schema)
    return done.withColumn("n_chars", F.length("text").cast("long"))
