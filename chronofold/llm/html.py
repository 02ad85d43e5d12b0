"""HTML extraction (operator 6).

Two passes over blocks.  The first classifies each block by the density of stop words, its length and its share of link text; blocks of
navigation, headers, footers, sidebars, notices, adverts, forms and comments are known by what holds them.  In the second, short
blocks, which tell little by themselves, take the class of their nearest decided neighbours.  An article element is one more hint: it leads
if it holds at least half of the good text, and then undecided blocks in it stay more easily, and those outside need a high density and length.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship
from .util import put, steps

# Elements by the part they play.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
SKIPPED = frozenset("head script style noscript template svg math iframe object canvas audio video textarea select button".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog fieldset header".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"body"}}
HEADINGS, WALLS = frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset("article table td body".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words of a class or id that mark what is no part of an article.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising adsense adslot adbox banner sponsor sponsored sponsors promo promos promotion promoted cookie cookies consent gdpr notice notices notification alert disclaimer popup modal overlay newsletter subscribe subscription signup login paywall comment comments commentlist respond disqus replies reply discussion sidebar side rail widget widgets nav navbar navigation menu submenu topbar breadcrumb breadcrumbs pager pagination header masthead footer foot copyright legal share sharing social related recommended recommendations trending teaser tags toolbar search skip hidden".split())
STOP_WORDS = frozenset(
    """a about after all also an and any are as at be because been but by can could did do for from had has have he her his how i if in into is it its
    just like more my no not now of on one only or other our out over she so some such than that the their them then there these they this to up was we
    were what when which who will with would you your
    al como con de del el en es esta este ha la las lo los más me mi muy no nos o para pero por que se si sin sobre su sus también un una y ya
    à au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui ma mais même mes mon ne nous on ou où par pas pour qu que qui sa
    sans se ses son sur tu un une vous
    aber als am an auch auf aus bei bin bis das dass dem den der des die doch durch ein eine einem einen einer eines er es für hat ich ihr im in ist ja
    kann mein mit nach nicht noch nur oder sein sich sie sind so über um und uns unter vom von vor war was wenn wer wie wir zu zum zur""".split()
)

SHORT, LONG = 70, 200
LINKS, STOPS_LOW, STOPS_HIGH = 0.33, 0.2, 0.3

#: Elements whose contents are no markup, up to their end tag; of the second kind only if there is one.
RAW, RAW_IF_CLOSED = frozenset("script style textarea".split()), frozenset("noscript template svg iframe".split())
_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
_STOP = re.compile(r"""[>"']""")
_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in RAW | RAW_IF_CLOSED}
#: Numbers of references that are too large for a character, and zeros that say nothing: html.unescape takes numbers of any length for numbers.
_LARGE, _ZEROS = re.compile(r"&#(?:[1-9][0-9]{7,}|[xX][1-9a-fA-F][0-9a-fA-F]{6,});?"), re.compile(r"(&#[xX]?)0+(?=[0-9a-fA-F])")
_NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_PART = re.compile(r"[a-z]+")
_LETTERS = re.compile(r"[^\W\d_]+")


def marked(attributes: str) -> bool:
    """Whether class, id or role tell that an element is no part of an article."""
    for m in _NAMED.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if name == "role":
            if value.lower() in ROLES:
                return True
        elif name == "hidden" or name == "aria-hidden":
            if name == "hidden" or value.lower() == "true":
                return True
        else:
            camel = re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()
            if not MARKS.isdisjoint(_PART.findall(camel)):
                return True
    return False


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closes, attributes) of each piece of markup, in time linear in the page; comments, declarations and elements that
    hold no markup have no name.

    A tag ends at the first ``>`` outside quotes.  A quote that nothing closes counts for nothing, and once no ``>`` outside quotes is left,
    quotes count for nothing in all that follows.
    """
    at, n, last = page.find("<"), page.rfind(">"), {q: page.rfind(q) for q in "\"'"}
    unclosed: set[str] = set()
    while at >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, "", False, ""
        elif at > n:
            return
        elif page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at) + 1
            yield at, end, "", False, ""
        elif m := _NAME.match(page, at + 1):
            k = m.end()
            while (stop := _STOP.search(page, k)) and stop[0] != ">":
                k = page.find(stop[0], stop.end()) + 1 if stop.start() < last[stop[0]] else stop.end()
            if not stop:
                last = dict.fromkeys(last, -1)
                stop = _STOP.search(page, page.find(">", m.end()))
            end, name, attributes = stop.end(), m[0].lower(), page[m.end() : stop.start()]
            if (raw := _ENDS.get(name)) and name not in unclosed and (name in RAW or not attributes.endswith("/")):
                close = raw.search(page, end)
                if close or name in RAW:
                    end, name = close.end() if close else len(page), ""
                else:
                    unclosed.add(name)
            yield at, end, name.lstrip("/"), name.startswith("/"), attributes
        else:
            end = at + 1
        at = page.find("<", end)


def blocks(page: str) -> list[tuple[str, int, bool, bool, bool]]:
    """(text, characters in links, in boilerplate, in an article, is a heading) of each block that has text, in page order."""
    out: list[tuple[str, int, bool, bool, bool]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, skipped, boilerplate, article
    #: Where in the stack each tag, what ends inline elements, and blocks stand.
    places: dict[str, list[int]] = {}
    walls: list[int] = []
    held: list[int] = []
    texts: list[str] = []
    linked = links = heading = 0
    at = 0

    def flush() -> None:
        nonlocal linked
        if texts:
            text = " ".join("".join(texts).split())
            if text:
                _, _, bad, article = stack[-1] if stack else ("", False, False, False)
                out.append((text, linked, bad, article, bool(heading)))
            texts.clear()
        linked = 0

    def say(part: str) -> None:
        nonlocal linked
        if part and not (stack and stack[-1][1]):
            plain = html.unescape(_LARGE.sub("\ufffd", _ZEROS.sub(r"\1", part))) if "&" in part else part
            texts.append(plain)
            if links:
                linked += len(" ".join(plain.split()))

    def leave(depth: int) -> None:
        nonlocal links, heading
        while len(stack) > depth:
            tag = stack[-1][0]
            if tag in BLOCKS:
                flush()
            links -= tag == "a"
            heading -= tag in HEADINGS
            stack.pop()
            places[tag].pop()
            for some in (walls, held):
                if some and some[-1] == len(stack):
                    some.pop()

    for start, end, tag, closes, attributes in tags(page):
        say(page[at:start])
        at = end
        if not tag:
            continue
        if closes:
            if (k := places.get(tag)) and (tag in BLOCKS or not walls or k[-1] >= walls[-1]):
                leave(k[-1])
            if tag == "p" or tag == "br":
                flush() if tag == "p" else say(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            else:
                say(" " if tag == "br" else "")
            continue
        if tag in BLOCKS:
            if held and tag in CLOSED_BY.get(stack[held[-1]][0], ()):
                leave(held[-1])
            # an inline element left open ends with the block it stands in
            flush()
        elif tag == "a" and links and (not walls or places["a"][-1] >= walls[-1]):
            # links hold no links
            leave(places["a"][-1])
        _, skip, bad, article = stack[-1] if stack else ("", False, False, False)
        inside = article or tag in ("article", "main")
        own = tag in BOILERPLATE and not (tag == "header" and article) or tag not in ("html", "body", "article", "main") and bool(attributes) and marked(attributes)
        if attributes.rstrip().endswith("/") and tag not in BLOCKS:
            continue
        if tag in WALLS:
            walls.append(len(stack))
        if tag in BLOCKS or tag == "head":
            held.append(len(stack))
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, skip or tag in SKIPPED, bad or own, inside))
        links += tag == "a"
        heading += tag in HEADINGS
    say(page[at:])
    leave(0)
    flush()
    return out


def classes(found: list[tuple[str, int, bool, bool, bool]]) -> list[bool]:
    """Whether each block belongs to the main text."""
    first: list[str] = []
    densities: list[float] = []
    for text, linked, bad, _, heading in found:
        n, said = len(text), [w.lower() for w in _LETTERS.findall(text)]
        density = sum(w in STOP_WORDS for w in said) / len(said) if said else 0
        densities.append(density)
        if bad or linked > LINKS * n and not heading:
            first.append("bad")
        elif n < SHORT:
            first.append("short")
        else:
            first.append("good" if density >= STOPS_LOW else "near" if density > 0 or heading else "none")
    # an article element leads where it holds at least as much of the text that the words show to be good as the rest of the page
    held = [sum(len(found[k][0]) for k, c in enumerate(first) if c == "good" and found[k][3] == inside) for inside in (False, True)]
    framed = any(article and not bad for _, _, bad, article, _ in found) and held[1] >= held[0]
    for k, (text, _, _, article, _) in enumerate(found):
        if framed and not article and not (first[k] == "good" and densities[k] >= STOPS_HIGH and len(text) >= LONG):
            first[k] = "bad"
        elif first[k] == "none":
            # without any stop word, the blocks around decide where the element leads
            first[k] = "near" if framed else "bad"
    decided = [k for k, c in enumerate(first) if c in ("good", "bad")]
    out, j = [], 0
    for k, c in enumerate(first):
        while j < len(decided) and decided[j] < k:
            j += 1
        if c in ("good", "bad"):
            out.append(c == "good")
            continue
        around = [first[decided[i]] for i in (j - 1, j) if 0 <= i < len(decided)]
        if framed:
            # within the article only what is decided there counts
            around = [x for i, x in ((i, first[decided[i]]) for i in (j - 1, j) if 0 <= i < len(decided)) if found[decided[i]][3] and not found[decided[i]][2]]
            out.append(not around or "good" in around)
        else:
            out.append(bool(around) and ("good" in around if c == "near" or found[k][4] else all(x == "good" for x in around)))
    return out


def extract(page: str) -> str:
    """The main text: its blocks in page order, white space in each made one space, joined by line feeds."""
    found = blocks(page)
    return "\n".join(b[0] for b, good in zip(found, classes(found), strict=True) if good)


def main_text(df: DataFrame, *, html: str = "html", out: str = "text") -> DataFrame:
    """``df`` with the main text of its column of pages (empty if there is none, or the page is null or empty) and n_chars, its code points.

    Every row stays; columns of these names are replaced.
    """
    ship(df.sparkSession)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([extract(x) for pages in steps(batch) for x in pages], pa.string())

    done = put(df, **{out: run(F.col(f"`{html}`"))})
    return put(done, n_chars=F.length(f"`{out}`").cast("long"))
