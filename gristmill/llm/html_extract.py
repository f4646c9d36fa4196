"""HTML extraction: the main text of a page, by rules over its blocks in two passes."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Frequent function words of the languages that pages are written in; their share tells prose from menus.
STOP_WORDS = frozenset(
    (
        "a an and are as at be been but by for from had has have he her his i if in is it its no not of on or our "
        "she so that the their them they this to was we were what when which who will with you your "
        "aber als am an auch auf aus bei bin bis da das dass dem den der des die du durch ein eine einem einen einer "
        "er es für hat ich ihr im in ist ja kein mit nach nicht noch nur oder sich sie sind so über um und uns von "
        "vor war was wenn wie wir wird zu zum zur "
        "au aux avec ce ces cette dans de des du elle en est et eux il je la le les leur lui mais me même mes moi "
        "mon ne nos notre nous on ou où par pas pour qu que qui sa se ses son sur ta te tu un une vous "
        "al como con de del el ella en entre era es esta este ha hay la las le lo los más me mi muy no nos o para "
        "pero por que se ser si sin sobre son su sus también un una uno y ya"
    ).split()
)

#: Characters below which a block says too little, and from which prose is good at once.
SHORT, LONG = 70, 200
#: Shares of stop words of prose and of what may be prose; the share of linked characters of a menu.
STOP_HIGH, STOP_LOW, LINKS = 0.30, 0.10, 0.5
#: Prose of other languages has stop words of none of these: it is told by its length, its sentences (how many at least,
#: and how long on average) and its share of linked characters.
SENTENCES, SENTENCE, FEW_LINKS = 2, (20, 600), 0.2

_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
_RAW = frozenset("script style noscript template textarea title svg iframe".split())
_ZONES = frozenset("nav header footer aside form menu dialog button select fieldset head search".split())
#: Names (class, id, role) of what is around an article; a name counts only as a whole, alone or with the words below
#: that say where or in what form such a thing stands.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc header masthead footer foot "
    "sidebar aside widget widgets related recommended recommendations share sharing comment comments disqus "
    "respond replies reply complementary contentinfo search skip copyright".split()
)
#: Those of what is never an article, whatever else the page has.
_NEVER = frozenset(
    "comment comments commentaire commentaires comentario comentarios kommentar kommentare disqus respond replies reply opinions discussion "
    "ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr".split()
)
_FORMS = frozenset(
    "site page main global top bottom left right upper lower first last primary secondary social links link list box bar area "
    "section block wrapper wrap container inner outer slot unit item items entry posts post articles stories news user users reader "
    "readers text body content form button buttons icons thread policy message mobile desktop sticky fixed js".split()
)
#: What a notice without a name says; it is looked for outside marked articles.
_NOTICE = re.compile(
    r"\b(?:we|(?:this|our) (?:web)?site)\b.{0,60}\buses? (?:\w+ ){0,2}cookies\b|\bverwende[nt] (?:\w+ ){0,3}cookies\b"
    r"|\butilis\w+ (?:\w+ ){0,2}cookies\b|\butiliz\w+ (?:\w+ ){0,2}cookies\b", re.I | re.S,
)
#: Ends of sentences; signs of which one says about as much as two or three letters.
_SENTENCE_END = re.compile(r"[.!?…]+(?=\s|$|[\"'»”)])|[。！？؟।॥።]")
_WIDE = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff]|[\U00020000-\U0003ffff]")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<more>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<more2>[^>]*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][^\s=/>\"']*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.S)
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    linked: int  # characters of the raw text inside links
    raw: int
    away: bool  # inside a menu, header, footer, advert or the like, by element
    named: int  # the same by a class name, id or role: 0 no, 1 yes, 2 by one of what is never an article
    article: int  # the number of the article or main part that holds it, 0: none
    marked: bool  # whether that is an article
    tag: str
    label: str = ""


def _is_around(name: str) -> int:
    parts = [p.lower() for p in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", name)]
    if not all(p in _NAMES or p in _NEVER or p in _FORMS or p.isdigit() for p in parts):
        return 0
    return 2 if any(p in _NEVER for p in parts) else int(any(p in _NAMES for p in parts))


def _named_away(more: str) -> int:
    if "=" not in more:
        return 0
    names = (m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(more) if m[1].lower() in ("class", "id", "role"))
    return max((_is_around(x) for own in names for x in own.split()), default=0)


def blocks(page: str) -> list[Block]:
    """The blocks of text of a page, in order. Tags may be unclosed or wrongly nested; what is not a tag is text."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int, int, bool]] = []  # open blocks: tag, away, named, article, marked
    opened: Counter[str] = Counter()
    links, articles = 0, 0
    held: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal held, linked
        if held:
            raw = "".join(held)
            text = " ".join(html.unescape(raw).split())
            if text:
                tag, away, named, article, marked = stack[-1] if stack else ("", False, 0, 0, False)
                out.append(Block(text, linked, max(1, len(raw)), away, named, article, marked, tag))
        held, linked = [], 0

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else size]
        if text:
            held.append(text)
            if links:
                linked += len(text)
        if not m:
            break
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                held.append(html.escape(m[0][9:-3]))
            continue
        more = m["more"] or m["more2"] or ""
        closing = bool(m["end"] or m["end2"])
        if name in _RAW and not closing:
            if not more.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = end.end() if end else size
            held.append(" ")
            continue
        if name == "a":
            links = 0 if closing else 1
        elif name == "br" or name == "wbr":
            held.append(" " if name == "br" else "")
        elif name in _BLOCKS or name == "button":
            flush()
            links = 0
            if closing:
                while opened[name]:
                    last = stack.pop()[0]
                    opened[last] -= 1
                    if last == name:
                        break
            elif name not in _VOID and not more.endswith("/"):
                if stack and (stack[-1][0] == "p" or stack[-1][0] == name and name in ("li", "dt", "dd", "td", "th", "tr", "option")):
                    opened[stack.pop()[0]] -= 1
                _, away, named, article, marked = stack[-1] if stack else ("", False, 0, 0, False)
                by_name = _named_away(more) if name not in ("body", "html", "main") else 0
                if (name in ("article", "main") or 'role="main"' in more) and not away and not by_name and not named:
                    if not article:
                        articles += 1
                        article = articles
                    marked = marked or name == "article"
                heading = len(name) == 2 and name[0] == "h" and article and stack and stack[-1][0] == "header"
                away = (away and not heading) or name in _ZONES
                stack.append((name, away, max(named, by_name), article, marked))
                opened[name] += 1
    flush()
    return out


def _in_sentences(text: str, linked: float) -> bool:
    """Whether a text reads as prose, whatever its language."""
    ends = len(_SENTENCE_END.findall(text))
    return ends >= SENTENCES and SENTENCE[0] <= _length(text) / ends <= SENTENCE[1] and linked < FEW_LINKS


def _length(text: str) -> int:
    return len(text) if text.isascii() else len(text) + 2 * len(_WIDE.findall(text))


def _first_pass(b: Block, has_article: bool) -> str:
    if b.away or b.named or (has_article and not b.article):
        return "bad"
    if b.marked:
        return "good"
    if _NOTICE.search(b.text):
        return "bad"
    density = b.linked / b.raw
    if density > LINKS and (not b.article or b.tag in ("li", "td", "div", "ul", "dd")):
        return "bad"
    if not b.article and (b.text.startswith("©") or "©" in b.text[:60]):
        return "bad"
    length = _length(b.text)
    if length < SHORT:
        return "short"
    words = _LETTERS.findall(b.text.lower())
    share = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    if share >= STOP_HIGH:
        return "good" if length >= LONG else "near"
    if share < STOP_LOW and _in_sentences(b.text, density):
        return "good" if length >= LONG else "near"
    if b.article or share >= STOP_LOW:
        return "near"
    return "bad"


def label(found: list[Block]) -> list[Block]:
    """Sets each block's label to good or bad.

    First pass: all that stands in an article and in none of what is named next is good, links and headings too. What stands in
    menus, headers, footers, forms and the like, or outside the article where a page marks one, is bad, and so is a block
    that is mostly links, or says that cookies are used; long prose, by its share of stop words or, in other
    languages, by its sentences, is good; short blocks and those between are left open. Second pass: an open block takes the
    label of the nearest decided block before and after; if they differ, near-prose is good and a short block
    follows the nearer one (the good one at a tie). Inside a page's main part neighbours are sought in it alone, and
    where none is decided all open blocks are good. On a page without any good block, near-prose is good. Class names
    say nothing on a page all of whose prose, of several blocks, stands under such names; but those of reader comments,
    adverts and notices of cookies always do.
    """
    if any(b.named == 1 for b in found):
        prose = [b.named for b in found if not b.away and b.named < 2 and b.linked / b.raw <= LINKS and _length(b.text) >= LONG]
        if len(prose) > 1 and all(prose):
            for b in found:
                b.named = 2 * (b.named == 2)
    has_article = any(b.article and not (b.away or b.named) for b in found)
    for b in found:
        b.label = _first_pass(b, has_article)
    if not any(b.label == "good" for b in found):
        for b in found:
            b.label = "good" if b.label == "near" else b.label
    first = [b.label for b in found]
    n = len(found)
    before, after = [None] * n, [None] * n
    for places, into in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: dict[int, int] = {}
        for i in places:
            into[i] = last.get(found[i].article)
            if first[i] in ("good", "bad"):
                last[found[i].article] = i
    for i, b in enumerate(found):
        if first[i] in ("good", "bad"):
            continue
        near = [j for j in (before[i], after[i]) if j is not None]
        labels = {first[j] for j in near}
        if b.article:
            b.label = "good" if "good" in labels or not labels else ("good" if first[i] == "near" else _nearest(i, near, first))
        elif len(labels) == 1:
            b.label = labels.pop()
        elif labels:
            b.label = "good" if first[i] == "near" else _nearest(i, near, first)
        else:
            b.label = "good"
    return found


def _nearest(i: int, near: list[int], first: list[str]) -> str:
    return first[min(near, key=lambda j: (abs(j - i), first[j] != "good"))]


def main_text(page: str | None) -> str:
    return "\n\n".join(b.text for b in label(blocks(page or "")) if b.label == "good")


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with text (the main text) in place of `column`; all other columns stay, but one named text.

    Null html counts as empty and gives an empty text; so does a page of menus alone. One row per row. A page
    is read whole, in one pass; memory is a few times its size.
    """
    kept = [c for c in pages.columns if c not in (column, "text")]
    df = pages.select(*kept, column)
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(p) for p in batch.column(len(kept)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=schema.names)

    return df.mapInArrow(run, schema)
