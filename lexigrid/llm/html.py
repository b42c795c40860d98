"""Main text of web pages by two passes of block rules.

The first pass decides blocks on their own: containers that say what they are make a block bad; a
marked article, length, link density and stop-word density have a vote each, and short and middling
blocks stay open. The second pass gives an open block the label of its nearest decided neighbours.
What a container's class or id says has no say where it would leave a page without any text.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm.shared import bound_batches, table

#: Frequent function words of the corpus languages.
STOP_WORDS = frozenset(
    """
    a about after all also an and any are as at be been but by can did do for from had has have he her his how i if in
    into is it its more my no not of on one or our out she so some than that the their them then there these they this to
    up was we were what when which who will with would you your
    aber als am an auch auf aus bei bin bis da das dass dem den der des die du durch ein eine einem einen einer er es für
    hat ich ihr im in ist ja kann man mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was
    wenn werden wie wir wird zu zum zur
    au aux avec ce ces cette comme dans de des du elle en est et eux il ils je la le les leur lui mais me même mes ne nos
    notre nous on ont ou où par pas plus pour qu que qui sa sans se ses si son sur ta te tout très tu un une vos vous
    al como con cual cuando de del desde donde el ella ellos en entre era es esa ese esta este fue ha han hasta hay la las
    le les lo los más me mi muy ni no nos o para pero por porque que se ser si sin sobre son su sus también tan te todo un
    una uno y ya yo
    """.split()
)

#: Characters: below SHORT a block stays open, above LONG it has a vote for its length.
SHORT, LONG = 70, 200
#: From STOP_HIGH on the density is a vote, below STOP_LOW a block without an article round it is weak;
#: up to LINKS_LOW the few links are a vote, above LINKS_HIGH a block is bad.
STOP_HIGH, STOP_LOW, LINKS_LOW, LINKS_HIGH = 0.15, 0.08, 0.1, 0.35
#: A block with at least so large a part in a link that goes round whole blocks is the card of another page.
CARD = 0.9

#: Elements by what they do to a page's blocks.
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes template canvas select object audio video annotation annotation-xml desc metadata".split())
#: Those that swallow the rest of a page where they are not closed.
SWALLOWS = frozenset("script style textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FORMULA = frozenset("math semantics mrow mi mn mo ms mtext mspace mstyle mfrac msqrt mroot msup msub msubsup mover munder munderover mmultiscripts mprescripts mpadded mphantom menclose merror mtable mtr mtd".split())
DRAWING = frozenset("svg g defs symbol use path circle ellipse rect line polyline polygon text tspan textpath marker mask pattern clippath lineargradient radialgradient stop filter image".split())
INLINE = FORMULA | DRAWING | frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form head header hgroup html label button legend li main menu nav ol option p section summary table tbody td tfoot th thead tr ul search".split())
CLOSED_BY_BLOCK = frozenset(("p",))
BOILER_TAGS = frozenset("aside button dialog footer form head label menu nav option search fieldset".split())
#: Words of class, id and role that name boilerplate, those that a container of the article itself may bear, and those
#: that say nothing about what a container holds.
STRONG = frozenset("ad ads advert adverts advertisement advertisements advertising adsense banner banners breadcrumb breadcrumbs comment comments commentlist complementary contentinfo cookie cookies consent disqus discussion footer gdpr menu menus modal nav navbar navigation newsletter pager pagination popup promo promotion promoted related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar".split())
WEAK = frozenset("alert aside copyright disclaimer foot header legal login masthead notice notices overlay recommendations recommended search side teaser toc topbar widget widgets".split())
CONTENT = frozenset("article body content entry main post story text".split())
NEUTRAL = frozenset("area bar block body bottom box btn button buttons card cards col column container content count counter cta first footer form global grid group head header heading holder id inline inner item items js last layer left link links list main meta module more page panel part position post posts primary right row section site slot small sticky sub tab tabs text thread title top unit user view widget wrap wrapper zone".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+>|[^>]*+>)""", re.DOTALL)
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s>/=]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)
PARTS = re.compile(r"[A-Za-z]+")
#: Class names that tell a state of the element, like ``has-sidebar`` or ``comments-open``, and not what it is.
STATE = re.compile(r"(?:has|have|is|no|not|with|without|show|hide)[-_].*|.*[-_](?:open|opened|closed|on|off|enabled|disabled|allowed|visible|active|count|left|right|layout)", re.IGNORECASE)


@dataclass
class Block:
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    boiler: bool = False
    named: bool = False
    doubted: bool = False
    card: bool = False
    article: bool = False
    heading: bool = False
    text: str = ""
    label: str = ""


def is_boilerplate(tag: str, attributes: str, in_article: bool) -> bool:
    """By its element, or hidden."""
    if tag in BOILER_TAGS or (tag == "header" and not in_article):
        return True
    return ("hidden" in attributes.lower() or "display" in attributes.lower()) and HIDDEN.search(attributes) is not None


def names_boilerplate(tag: str, attributes: str, in_article: bool) -> str:
    """By the words of its class, id and role, apart from those of its state: "yes", "no", or "doubt" inside an article.

    There a name is a verdict only if it says nothing else: ``comment-list`` and ``share`` do, while ``recipe-menu`` or
    ``related-work`` name a part of the article, and so does ``discussion``.
    """
    if "=" not in attributes or tag in ("body", "html", "main"):
        return "no"
    names = [n for m in NAMES.finditer(attributes) for n in (m.group(2) or m.group(3) or m.group(4) or "").split()]
    words = {w.lower() for n in names if not STATE.fullmatch(n) for w in PARTS.findall(n)}
    strong = words & STRONG
    if not strong and not (words & WEAK and not words & CONTENT and not (in_article and words & {"header"})):
        return "no"
    if not in_article:
        return "yes"
    plain = any(p and set(p) <= STRONG | WEAK | NEUTRAL and set(p) & (STRONG | WEAK) for n in names if not STATE.fullmatch(n) for p in [[w.lower() for w in PARTS.findall(n)]])
    return "yes" if plain and strong != {"discussion"} else "doubt"


def blocks_of(page: str) -> list[Block]:
    """Blocks with text in page order, with link characters and what contains them."""
    found: list[Block] = []
    block, stack, link = Block(), [], -1
    boiler = named = article = doubted = 0

    def flush():
        nonlocal block
        across = link >= 0  # a link round whole blocks
        block.text = " ".join("".join(block.pieces).split())
        if block.text:
            block.boiler, block.named, block.article, block.doubted = boiler > 0, named > 0, article > 0, doubted > 0
            block.card = (block.card or across) and block.linked >= CARD * len(block.text)
            found.append(block)
        block = Block(card=across)

    def add(raw: str):
        if raw:
            text = entities.unescape(raw)
            block.pieces.append(text)
            if link >= 0:
                block.linked += len(" ".join(text.split()))

    def leave(to: int):
        nonlocal boiler, named, article, doubted, link
        while len(stack) > to:
            _, b, c, a, d = stack.pop()
            boiler -= b
            named -= c
            article -= a
            doubted -= d
        if len(stack) < link:  # a link ends with what it was opened in, closed or not
            link = -1

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m.group(2) is None:
            continue
        closing, tag, attributes = bool(m.group(1)), m.group(2).lower(), m.group(3)[:-1]
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else n if tag in SWALLOWS else at
            continue
        if tag == "a":
            link = -1 if closing else len(stack)
            continue
        if tag in INLINE:
            if tag in ("br", "wbr", "img"):
                block.pieces.append(" " if tag == "br" else "")
            continue
        flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    leave(i)
                    break
            continue
        if tag in HEADINGS:
            block.heading = True
        if tag in VOID or attributes.endswith("/") or tag not in CONTAINERS:
            continue
        while stack and stack[-1][0] in CLOSED_BY_BLOCK:
            leave(len(stack) - 1)
        if tag == "body":
            leave(0)
        bad, called = is_boilerplate(tag, attributes, article > 0), names_boilerplate(tag, attributes, article > 0)
        inner = tag in ("article", "main") and not bad and called != "yes"
        row = (bad, called == "yes", inner, called == "doubt")
        boiler, named, article, doubted = (x + y for x, y in zip((boiler, named, article, doubted), row))
        stack.append((tag, *row))
    flush()
    return found


def stop_density(text: str) -> float:
    words = [w for raw in text.lower().split() if (w := raw.strip("\"'.,;:!?()[]{}«»“”„…%*#$&-"))]
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def first_pass(block: Block) -> str:
    """good, bad, or open: short, near (one vote) or weak (hardly a stop word)."""
    if block.boiler or block.card:
        return "bad"
    if block.linked > LINKS_HIGH * len(block.text):
        return "bad" if not block.article else "short"
    if block.heading or len(block.text) < SHORT:
        return "bad" if block.doubted else "short"
    density = stop_density(block.text)
    if density < STOP_LOW and not block.article:
        return "weak"
    votes = block.article - block.doubted + (density >= STOP_HIGH) + (len(block.text) > LONG) + (block.linked <= LINKS_LOW * len(block.text))
    return "good" if votes >= 2 else "bad" if block.doubted else "near"


def second_pass(scope: list[Block], article: bool) -> None:
    """Open blocks take the label of the nearest decided neighbours, near ones the better of two, weak ones the worse.

    ``scope`` is the blocks of the article or those outside it, without those in containers that name
    themselves boilerplate. With none decided, all of an article stay, and the near ones elsewhere.
    """
    first = [b.label for b in scope]
    before, last = [], ""
    for label in first:
        before.append(last)
        last = label if label in ("good", "bad") else last
    after, last = [], ""
    for label in reversed(first):
        after.append(last)
        last = label if label in ("good", "bad") else last
    after.reverse()
    for b, label, left, right in zip(scope, first, before, after):
        if label in ("good", "bad"):
            continue
        if label == "weak":
            b.label = "good" if left == right == "good" else "bad"
        elif not left and not right:
            b.label = "good" if article or label == "near" else "bad"
        elif b.heading and right:
            b.label = right
        elif not left or not right or left == right:
            b.label = left or right
        else:
            b.label = "good" if label == "near" else "bad"


def judged(blocks: list[Block], names: bool = True) -> str:
    """Both passes over a page's blocks; without ``names`` those of named containers stand on their own votes.

    On a page with weak blocks and none better, the stop words are of other languages than its own
    or its text is a table: there the density has no say, and long blocks are good. On a page with short
    blocks alone, those with few links are its text if a heading or their stop words together say so.
    """
    for b in blocks:
        b.label = "bad" if names and b.named else first_pass(b)
        if b.named and b.label == "short":
            b.label = "bad"
    free = [b for b in blocks if not b.boiler and not (names and b.named)]
    if not any(b.label in ("good", "near") for b in free):
        weak = [b for b in free if b.label == "weak"]
        for b in weak:
            b.label = "good" if len(b.text) > LONG else "short"
        short = [b for b in [b for b in free if b.article] or free if b.label == "short" and b.linked <= LINKS_HIGH * len(b.text)]
        if not any(b.label == "good" for b in free) and (weak or any(b.heading for b in short) or stop_density(" ".join(b.text for b in short)) >= STOP_LOW):
            for b in short:
                b.label = "good"
    for article in (True, False):
        second_pass([b for b in free if b.article == article], article)
    return "\n".join(b.text for b in blocks if b.label == "good")


def main_text(page: str | None) -> str:
    """The good blocks, a line each; where the names of containers leave none, the passes go without them."""
    blocks = blocks_of(page or "")
    text = judged(blocks)
    return text if text or not any(b.named for b in blocks) else judged(blocks, names=False)


def _extract(batches):
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(df: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of ``df``.

    Null and empty pages, and those without a good block, have empty text; broken markup is read
    as far as it goes; null ids and urls and repeated rows stay; other columns are not read.
    """
    bound_batches(df.sparkSession)
    picked = df.select(F.col(page).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return picked.mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
