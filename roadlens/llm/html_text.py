"""Main text of web pages by two-pass block rules."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from roadlens.llm.common import ids_of, map_slices, query, table, texts_of

# Element names of HTML by role, words of class names, frequent function words.
RAW = "script style noscript template iframe svg math object video audio canvas textarea select title noembed xmp"
VOID = "area base br col embed hr img input link meta source track wbr"
INLINE = "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr"
LEFT_OUT = "head nav header footer aside form button dialog fieldset menu"
HINTS = (
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar ad ads adv advert adverts advertisement advertising sponsor sponsored"
    " promo promotion banner cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login share"
    " sharing social related recommended recommendations comment comments disqus respond reply replies toolbar pagination pager widget"
    " masthead header skip alert paywall hidden teaser toc"
)
ROLES = "navigation banner contentinfo complementary search form alert dialog menu menubar"
STOP_WORDS = (
    "the of and a to in is that it was for on are as with his they at be this from have or by an not which you her she he we all their"
    " der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei"
    " de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec aux ou elle"
    " el los las y por con para del una su al lo como más pero sus este ha si o no"
    " di che il è per non i del una sono della e da do os um uma com não het een van op te dat niet zijn"
)

#: Rules of the first pass: density of links; characters of a short and of a long block; density of stop words.
LINK_DENSE, SHORT, LONG, STOP_LOW, STOP_HIGH = 0.2, 70, 200, 0.30, 0.32

_RAW, _VOID, _INLINE, _OUT = (frozenset(x.split()) for x in (RAW, VOID, INLINE, LEFT_OUT))
_HINTS, _ROLES, _STOP = frozenset(HINTS.split()), frozenset(ROLES.split()), frozenset(STOP_WORDS.split())
_COMMENTS = frozenset("comment comments disqus respond reply replies".split())
_OPTIONAL = frozenset("p li dt dd tr td th option thead tbody tfoot".split())  # end before a next one of their kind

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[^\W_]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_NAMES = re.compile(r"[^A-Za-z]+")
_END = {n: re.compile(rf"</{n}(?=[\s/>]|\Z)", re.I) for n in _RAW}


@dataclass
class Block:
    """Text between two block tags. ``where``: the container whose blocks may lend it their label."""

    text: str
    links: int
    tag: str
    where: int
    out: bool
    article: bool
    label: str = ""
    good: bool = False


@dataclass
class _Open:
    tag: str
    out: bool
    comments: bool
    article: bool
    where: int


def _hinted(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether attributes mark something beside the article, and whether it is readers' comments."""
    if not attributes or attributes.isspace():
        return False, False
    out = comments = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            words = {w.lower() for w in _NAMES.split(_CAMEL.sub(" ", value))}
            out |= bool(words & _HINTS)
            comments |= bool(words & _COMMENTS)
        elif name == "role":
            out |= value.lower() in _ROLES
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            out = True
    return out, comments


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, with their containers; markup, scripts and styles are gone."""
    found: list[Block] = []
    stack = [_Open("", False, False, False, 0)]
    containers = 0
    parts: list[str] = []
    linked, in_link, tag = 0, 0, ""

    def flush():
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            top = stack[-1]
            found.append(Block(text, linked, tag, top.where, top.out, top.article))
        parts, linked = [], 0

    def add(text: str):
        nonlocal linked
        if text:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if in_link:
                linked += len(text.strip())

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if name in _RAW:
            if not m[1] and not m[3].endswith("/"):
                close = _END[name].search(page, at)
                at = close.start() if close else end
            continue
        if name in _INLINE:
            if name == "a":
                in_link = 0 if m[1] else 1
            elif not m[1] and name not in _VOID and _hinted(name, m[3])[0]:
                flush()
                stack.append(_Open(name, True, False, False, stack[-1].where))
            elif m[1] and stack[-1].tag == name:
                flush()
                stack.pop()
            continue
        flush()
        tag = name
        if name in _VOID:
            continue
        if m[1]:
            tag = ""
            in_link = 0
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == name), 0)
            if depth:
                del stack[depth:]
            continue
        if name in _OPTIONAL and stack[-1].tag == name:
            stack.pop()
        top = stack[-1]
        hinted, comments = _hinted(name, m[3])
        comments |= top.comments
        if name in ("article", "main"):
            containers += 1
            stack.append(_Open(name, hinted or comments, comments, not (hinted or comments), containers))
        elif name in ("html", "body"):
            stack.append(_Open(name, top.out, top.comments, top.article, top.where))
        else:
            out = top.out or hinted or comments or name in _OUT and not (name == "header" and top.article)
            if out != top.out:
                containers += 1
            stack.append(_Open(name, out, comments, top.article and not out, containers if out != top.out else top.where))
    flush()
    return found


def classify(found: list[Block]) -> list[Block]:
    """Both passes: rules for each block alone, then labels of neighbours for the undecided ones."""
    has_article = any(b.article for b in found)
    for b in found:
        if b.out or has_article and not b.article:
            b.label = "bad"
            continue
        n = len(b.text)
        words = _WORD.findall(b.text.lower())
        stop = sum(w in _STOP for w in words) / len(words) if words else 0.0
        density = b.links / n
        if density > LINK_DENSE:
            b.label = "near" if b.article else "bad"
        elif n < SHORT:
            b.label = "bad" if b.links and not b.article else "short"
        elif stop >= STOP_HIGH:
            b.label = "good" if n > LONG else "near"
        elif stop >= STOP_LOW:
            b.label = "near"
        else:
            b.label = "short" if b.article else "bad"
    _menus(found)
    left = _nearest(found)
    right = [r and (r[0], len(found) - 1 - r[1]) for r in _nearest(found[::-1])[::-1]]
    for i, b in enumerate(found):
        if b.label in ("good", "bad"):
            b.good = b.label == "good"
            continue
        before, after = left[i], right[i]
        if after and re.fullmatch("h[1-6]", b.tag):  # a heading goes with what follows it
            b.good = after[0]
        elif before and after and before[0] != after[0]:
            a, z = i - before[1], after[1] - i
            b.good = (before if a < z else after)[0] if a != z else b.label == "near"
        elif before or after:
            b.good = (before or after)[0]
        else:  # nothing near it is decided: what holds it decides
            b.good = b.article or b.label == "near"
    return found


def _menus(found: list[Block]) -> None:
    """Three or more list entries in a row that are nothing but links are a menu, in an article too."""
    run: list[Block] = []
    for b in [*found, Block("", 0, "", -1, False, False)]:
        if b.tag == "li" and b.links >= 0.9 * len(b.text):
            run.append(b)
            continue
        if len(run) >= 3:
            for x in run:
                x.label = "bad"
        run = []


def _nearest(found: list[Block]) -> list[tuple[bool, int] | None]:
    """For each block the last decided one before it in the same container: (good, place)."""
    last: dict[int, tuple[bool, int]] = {}
    out = []
    for i, b in enumerate(found):
        out.append(last.get(b.where))
        if b.label in ("good", "bad") and not (b.tag == "li" and b.article and b.label == "bad"):
            last[b.where] = (b.label == "good", i)
    return out


def main_text(page: str) -> str:
    return " ".join(b.text for b in classify(blocks(page)) if b.good)


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars``: the article of each whole page.

    A null or empty page, or one without an article, gives the empty text. Null and repeated ids are kept;
    an empty table gives an empty result; other columns are not read. Damaged markup (unclosed tags,
    comments or quotes) never fails. Nothing is shuffled.
    """

    def make():
        def work(part):
            texts = [main_text(p) for p in texts_of(part, "html")]
            return {"page_id": ids_of(part, "page_id"), "url": ids_of(part, "url"), "text": texts, "n_chars": [len(t) for t in texts]}

        return work

    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].alias("html"))
    return map_slices(rows, make, "page_id long, url string, text string, n_chars long")


def block_table(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per block: ``page_id, block, tag, text, links, label, good``, the first pass's label and the final one."""

    def make():
        def work(part):
            rows = [(key, i, b.tag, b.text, b.links, b.label, b.good) for key, page in zip(ids_of(part, "page_id").to_pylist(), texts_of(part, "html")) for i, b in enumerate(classify(blocks(page)))]
            names = "page_id block tag text links label good".split()
            return {n: [r[i] for r in rows] for i, n in enumerate(names)}

        return work

    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[html_col].alias("html"))
    return map_slices(rows, make, "page_id long, block int, tag string, text string, links int, label string, good boolean")


@query("op1_html_text")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
