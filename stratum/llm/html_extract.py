"""Main text of web pages by block rules in two passes.

A page is cut into blocks at block-level tags. The first pass decides blocks by length, link density and
stop-word density; short or ambiguous blocks stay open. The second pass gives open blocks the label of
their nearest decided neighbours. What a page declares about itself is a further feature: elements and whole names
of page furniture (footers, notices, comments read like text, so that words cannot tell them), and the borders of
an article, which count as decided neighbours of what stands inside.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element names by their part in a page, and frequent words of four languages.
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp", "template", "svg", "math", "object", "canvas"}
_NO_TEXT = {"head", "select", "button", "option", "datalist", "audio", "video", "map", "input"}
_FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
_CLOSES_P = _BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "summary", "figcaption", "li", "dd", "dt"} | {"p"}
_CLOSES_SAME = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alert", "alertdialog", "form"}
# Words of class names and ids: those of page furniture, and those that may stand beside them. A name is one of furniture if it
# has no other words, so that ``cookie-notice`` is one and ``side-effects`` is none.
_FURNITURE_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adslot adbox banner sponsor sponsored promo promos promotion
    cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup
    nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead topbar toolbar
    comment comments commentlist disqus respond replies share sharing social related recommended recommendations
    pagination pager login search skip copyright disclaimer paywall teaser teasers taglist widget widgets""".split()
)
_NEUTRAL_NAMES = frozenset(
    """box boxes container wrapper wrap inner outer area block blocks section sections list lists item items row col column slot unit
    left right top bottom main primary secondary site page global local post article entry story news user reader reader's
    bar link links button buttons icon icons form text content title body fixed sticky mobile desktop small large first last reply thread""".split()
)
STOP_WORDS = frozenset(
    """the of and to in a is that it for on was as with be by are this at an from or not have has had he she they we you his her which were their will would can but all one there been if more when who what so no out up into than them some could about other then its over also after
    der die das und ist von den zu mit im ein eine auf für nicht des dem sich als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde
    le la les de des un une et est en que qui dans pour sur au par avec ne pas plus ce il se du son sa ses aux ou mais comme elle nous vous ils cette ces leur sont été être ont fait
    el los las una y es por con para del al lo su no más como pero sus este esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos""".split()
)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    links: int  # characters inside links
    tag: str
    banned: bool
    main: bool  # inside an article or main element
    label: str = ""


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}


def _named_furniture(names: str) -> bool:
    """Whether a class or id consists of words of furniture and neutral ones only."""
    for name in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", names).lower().split():
        words = [w for w in re.split(r"[-_:\d]+", name) if w]
        if any(w in _FURNITURE_NAMES for w in words) and all(w in _FURNITURE_NAMES or w in _NEUTRAL_NAMES for w in words):
            return True
    return False


def _furniture(tag: str, a: dict[str, str], in_main: bool) -> bool:
    """Whether an element declares itself, or what it holds, to be no part of the text."""
    if tag in _FURNITURE and not (tag == "header" and in_main):
        return True
    if not a or tag in ("html", "body"):
        return False
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return True
    return a.get("role", "").lower() in _ROLES or tag not in ("main", "h1") and _named_furniture(f"{a.get('class', '')} {a.get('id', '')}")


def blocks(page: str) -> list[Block]:
    """The page's blocks with text, in order; character references decoded, white space folded."""
    out: list[Block] = []
    open_: list[tuple[str, bool, bool, bool]] = []  # tag, no text, furniture, main; the last three inherited
    parts: list[str] = []
    links, in_link = 0, 0

    def flush() -> None:
        nonlocal links
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            tag = next((t for t, *_ in reversed(open_) if t in _BLOCK), "")
            _, _, banned, main = open_[-1] if open_ else ("", False, False, False)
            out.append(Block(text, min(links, len(text)), tag, banned, main))
        parts.clear()
        links = 0

    def put(text: str) -> None:
        nonlocal links
        if text and not (open_ and open_[-1][1]):
            text = html.unescape(text)
            parts.append(text)
            if in_link:
                links += len(_SPACE.sub(" ", text).strip())

    def close_to(k: int) -> None:
        nonlocal in_link
        if any(t in _BLOCK or f != (open_[k - 1][2] if k else False) for t, _, f, _ in open_[k:]):
            flush()
        in_link = max(0, in_link - sum(t == "a" for t, *_ in open_[k:]))
        del open_[k:]

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            k = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == tag), None)
            if k is not None:
                close_to(k)
            elif tag in ("p", "br"):
                flush() if tag == "p" else put(" ")
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if m[3].rstrip().endswith("/") and tag in ("svg", "math", "object", "iframe"):
                continue
            at = end.end() if end else n
            put(" ")
            continue
        if tag in ("br", "hr"):
            flush() if tag == "hr" else put(" ")
            continue
        if tag in _VOID:
            continue
        if tag in _CLOSES_P:
            k = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] in ("p", "button", "td", "li", "div", "article", "section", "body")), None)
            if k is not None and open_[k][0] == "p":
                close_to(k)
        if tag in _CLOSES_SAME:
            same = {"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else {tag}
            k = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] in same or open_[i][0] in _CLOSES_SAME[tag]), None)
            if k is not None and open_[k][0] in same:
                close_to(k)
        a = _attributes(m[3]) if m[3].strip(" \n\t/") else {}
        _, mute, banned, main = open_[-1] if open_ else ("", False, False, False)
        bad = _furniture(tag, a, main)
        if tag in _BLOCK or bad and not banned:
            flush()
        is_main = tag in ("article", "main") or a.get("role", "").lower() in ("main", "article") or a.get("itemprop", "").lower() == "articlebody"
        open_.append((tag, mute or tag in _NO_TEXT, banned or bad, main or is_main))
        in_link += tag == "a"
    flush()
    return out


def by_text(b: Block, short: int = 70, long: int = 200, stop_low: float = 0.1, stop_high: float = 0.2, most_links: float = 0.5) -> str:
    """First pass, by the words alone: good, bad, near (good beside good) or open."""
    words = [w.lower() for w in _WORD.findall(b.text)]
    stop = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    density = b.links / len(b.text)
    if density > most_links:
        return "bad" if density > 0.8 or len(b.text) >= short else "open"
    if re.match(r"\s*(?:©|\(c\)\s|copyright\b|all rights reserved)", b.text, re.I) and len(b.text) < long:
        return "bad"
    if len(b.text) < short:
        return "open"
    if stop >= stop_high and density < 0.3:
        return "good" if len(b.text) >= long else "near"
    return "near" if stop >= stop_low and density < 0.3 else "open"


def classify(found: list[Block], declared: bool = True) -> None:
    """Set every label to good or bad; ``declared``: use what the page says by elements and names, too.

    The second pass walks from each undecided block to the nearest decided ones; the borders of an
    article or main element are decided: good from inside, and unknown from outside, where the walk goes on. Of
    two that differ, the nearer wins; headings go with what follows; near blocks, and all inside an article, with a good neighbour
    on either side, so that there only what stands among links goes.
    Without any decided neighbour, paragraphs and headings are good.
    """
    for b in found:
        b.label = "bad" if declared and b.banned else by_text(b)
        if declared and b.main and not b.banned and b.label == "bad" and b.tag in ("p", "h1", "h2", "h3", "pre", "blockquote", "figcaption"):
            b.label = "open"  # a paragraph that is one link, in an article
        elif declared and b.main and b.label == "near":
            b.label = "good"

    def nearest(order: list[int]) -> dict[int, tuple[str, int]]:
        out, last = {}, ("", 0)
        before = None
        for i in order:
            b = found[i]
            if declared and before is not None and b.main and not b.banned and not (before.main and not before.banned):
                last = ("good", i - (1 if order[0] == 0 else -1))  # the border is crossed into an article
            out[i] = last
            if b.label in ("good", "bad"):
                last = (b.label, i)
            before = b
        return out

    forth, back = nearest(list(range(len(found)))), nearest(list(range(len(found) - 1, -1, -1)))
    decided = {}
    for i, b in enumerate(found):
        if b.label in ("good", "bad"):
            continue
        (left, l), (right, r) = forth[i], back[i]
        if (b.label == "near" or declared and b.main) and "good" in (left, right):
            decided[i] = "good"
        elif left == right or not left or not right:
            decided[i] = left or right or ("good" if b.tag in ("p", "h1", "h2", "h3", "pre", "blockquote") else "bad")
        elif b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            decided[i] = right
        else:
            decided[i] = left if i - l <= r - i else right
    for i, label in decided.items():
        found[i].label = label


def main_text(page: str | None) -> str:
    """Good blocks of a page joined by line feeds; empty for a null page or one without any."""
    found = blocks(page or "")
    classify(found)
    return "\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame, html_column: str = "html", out: str = "text") -> DataFrame:
    """Replace the html column by the main text, in column ``out``; another column of that name is replaced.

    Null or empty html gives an empty text; rows are independent, so repeated ones get equal texts. Nothing is cut off, however long.
    """
    names = [c for c in pages.columns if c not in (html_column, out)]
    narrow = pages.select(*names, F.col(html_column).alias("_html"))

    def run(batches):
        for b in batches:
            texts = [main_text(x) for x in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(texts, pa.string())], [*names, out])

    return narrow.mapInArrow(run, T.StructType([*(f for f in narrow.schema if f.name != "_html"), T.StructField(out, T.StringType())]))
