"""HTML extraction (operator 2): two-pass block rules.

A page is cut into blocks at block-level tags.  Pass 1 decides blocks by link
density, length and stop-word density; pass 2 gives each undecided block the
label of its nearest decided neighbours.

What a tag or its class, id or role names as menu, header, footer, sidebar,
notice, advert, form, reader comment, script or style is decided as boilerplate
before the rules.  What only a class or id names so is a wrapper all the same, and
loses nothing but its own boilerplate, if it holds the page's only article or
main elements or, without such, most of its prose; so is a form.  Inside an
article a name counts by its last word that is no layout, so names of its subject
drop nothing.  Of several articles in one main element, the one with most of the
prose stays.  If a page has an ``article`` or ``main`` element, the blocks
outside it are boilerplate too; inside it, a long block without stop words is
undecided (prose of an unknown language, tables) rather than boilerplate, and a
block without any decided neighbour stays.

On other pages, blocks of prose that follow each other are long or short by their
joint length.  A page whose prose has few stop words as a whole is of a language
without a list (or with too short a one): there, and in a script without lists,
missing stop words say nothing, and blocks are judged by links and length.  If no
block is good, the runs of undecided blocks stay that hold a longer block or are
long together, and all undecided blocks of a page that has no decided one.

Text: character references are decoded, white space in a block becomes one
space, blocks are trimmed and joined by one line feed in page order.

Defined cases: null, empty and text-free html give an empty text; text before
any tag is a block; unclosed tags end with what holds them; any length is read
whole; repeated rows give repeated results.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructType

from blotter.llm.common import field, map_rows, with_row

# Fixed values.  Lengths in characters, densities as shares.
LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH = 0.10, 0.20
LINKS_OUTSIDE, LINKS_INSIDE = 0.2, 0.6
#: Languages that share words stand together; the list that fits a block best counts.
STOP_LISTS = [frozenset(x.split()) for x in ("""
a an and are as at be but by for from has have he her his i if in is it its not of on or she that the their there they
this to was we were which will with you
aber als am auch auf aus bei das dem den der des die ein eine einer es für im ist mit nicht noch sich sie sind so und
von vor war werden wie wird zu zum zur
au aux avec ce cette dans de des du elle en est et il la le les leur mais ne ou par pas plus pour que qui sa se son sont
sur un une
al como con del el ella en era es esta este la las lo los más no o para pero por que se sin su sus un una y
""", """
и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по ее мне было вот от о из ему для при это
этот эта эти или мы они был была были быть который которые до если уже когда также их чем
""", """
і й в у не що він на я з із як а то все вона так його але та до від за по для при це цей ця ці або ми вони був була
було були який які якщо вже коли також їх про
""", """
и в на не че той се за от да с си е са като а но по до при това този тази тези или ние те беше бяха който които ще му ги
""", """
i w we z ze na do nie się że to jest są o od po za jak ale co dla przez przy który która które oraz tym tego jego jej
ich był była było były być a u tak czy już tylko
""", """
a i v ve s se na do z ze že je jsou o od po za jak ale pro při který která které byl byla bylo být nebo by si jeho ako
sa so nie to sú bol bola bolo pre pri ktorý ktorá ktoré
""", """
i u na se je da su za od iz o po s sa kao ali što koji koja koje bio bila bilo biti ili ne to ovaj ova in je ki za pa ni
""", """
ve bir bu da de için ile o ne gibi daha çok olarak olan var en kadar sonra ama her ki mi ya ise değil onun ben biz onlar
""", """
di e il la lo i gli le un uno una a in che non è per con da del della dei delle nel nella al alla si come più ma anche
sono era ha sul dal su se o
""", """
de e o a os as um uma em no na nos nas que não é para com por do da dos das ao à se como mais mas foi são era ou seu sua
""", """
de het een en van in is dat op te zijn met voor niet aan er om ook als maar bij door uit naar was dan nog of wordt die hij
""", """
och att det i en som på är av för med den till inte om ett har de var men så vi kan från eller hade og er på til ikke af
at han hun et fra jeg vi ble blev
""", """
ja on ei se että hän oli mutta kun niin ovat joka ole myös tai kuin jos sen mitä olla ollut vain sekä nyt
""", """
a az és hogy nem is egy ez meg de van volt ha már csak mint el vagy még azt ki be lesz után
""", """
și de a în la cu nu că pe o un se din mai este sunt care pentru au fost ca sau dar lui ale prin
""", """
yang dan di ke dari untuk dengan ini itu pada tidak adalah dalam juga akan atau oleh ada telah sebagai bahwa tersebut
""", """
và của là có cho không được một trong các đã với những người để này khi ở từ cũng như đến
""", """
και το η ο να του της με για την που τα στο στη από ότι είναι τον των δεν θα σε μια ένα ως οι τις τους αλλά
""", """
في من على أن إلى عن مع هذا هذه التي الذي كان كانت لا ما هو هي أو ثم بعد قد بين كل
""", """
של את על לא הוא היא זה עם כי גם אל או אם כל יש היה היתה זו אך אבל
""", """
के की का में है और से को पर ने यह कि एक हैं भी नहीं था थे इस वह या तो कर
""")]
STOP_WORDS: dict[str, tuple[int, ...]] = {w: tuple(i for i, x in enumerate(STOP_LISTS) if w in x)
                                          for w in frozenset().union(*STOP_LISTS)}
BLOCK_TAGS = frozenset("""
address article aside blockquote body canvas caption center col colgroup dd details dialog dir div dl dt fieldset
figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav
noframes ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul
""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED_TAGS = frozenset("""
aside audio button canvas datalist dialog fieldset footer frameset head iframe input label math menu nav noframes
noscript object optgroup option script search select style svg template textarea title video
""".split())
CONTENT_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED_NAMES = frozenset("""
ad adbox ads adslot advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment commentlist
comments consent cookie cookies copyright disclaimer discussion disqus footer form gdpr hidden legal login masthead menu
modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommended
related replies reply respond search share sharing sidebar sidenav signup skip social sponsor sponsored subnav subscribe
toast toolbar topbar topnav widget
""".split())
#: Words that make a class say something of the layout or state of an element, not what it is.
MODIFIERS = frozenset("""
accepted active closed collapsed disable disabled enable enabled exclude has hide inactive is loaded loading no non not
off on open opened show shown visible wide with without
""".split())
#: Words at the end of a name that say how a thing is laid out, not what it is.
LAYOUT = frozenset("""
area bar block blocks body bottom box button buttons col column container content footer group header icon icons inner
item items left line link links list module outer panel post posts region right row section slot story stories title top
unit wrap wrapper zone
""".split())
#: Names of what readers wrote: it may be most of a page's prose.
READERS = frozenset("comment commentlist comments discussion disqus replies reply respond".split())
DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                   r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[A-Za-z][^>]*>", re.S)
RAW_TAGS = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe")}
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME = re.compile(r"[a-z0-9]+")
LETTERS = re.compile(r"(?:[^\W\d_][\u0900-\u0903\u093a-\u094f]*)+")
#: Letters of scripts that no list is for, and of those that write several letters in one.
UNLISTED = re.compile("[^\\W\\d_\u0000-\u052f\u0590-\u06ff\u0900-\u097f\u1e00-\u1fff]")
DENSE = re.compile("[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")

GOOD, BAD, OPEN, PROSE = 1, 0, None, 2


#: How sure it is that an element is no article text: by tag, role or style; by a name; by a name of readers' comments.
SURE, NAMED, COMMENTS = 9, 2, 3


def named_part(words: list[str], inside: int) -> int:
    """What a class or id says.  Any word counts; inside an article, where names may speak of its subject, the last
    one that is no layout does."""
    if inside:
        last = next((w for w in reversed(words) if w not in LAYOUT and not w.isdigit()), words[-1] if words else "")
        words = [last]
    if not READERS.isdisjoint(words):
        return COMMENTS
    return NAMED if not DROPPED_NAMES.isdisjoint(words) or "header" in words and not inside else 0


def boilerplate(tag: str, attributes: str, inside: int = 0) -> int:
    """Whether a start tag opens something that is no article text; ``inside`` an article, a header is its own."""
    if tag in DROPPED_TAGS or tag == "header" and not inside:
        return SURE
    # Some pages stand in a form as a whole; it is judged like an element with a name.
    form = NAMED if tag == "form" else 0
    return max(form, attributed(tag, attributes, inside)) if form else attributed(tag, attributes, inside)


def attributed(tag: str, attributes: str, inside: int) -> int:
    """``boilerplate`` by the attributes alone."""
    if not attributes.strip() or tag in CONTENT_TAGS and "comment" not in attributes.lower() or tag in ("html", "body"):
        return 0
    named = 0
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            for token in value.split():
                words = NAME.findall(token)
                if not MODIFIERS.isdisjoint(words):
                    continue
                # Inside an article, ids of paragraphs and headings are places to link to.
                if inside and name == "id" and (tag == "p" or tag in HEADINGS):
                    continue
                if tag in HEADINGS:
                    words = [w for w in words if w != "header"]
                named = max(named, named_part(words, inside))
        elif name == "role" and value in DROPPED_ROLES:
            return NAMED if value == "form" else SURE
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            return SURE
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return SURE
    return named


class Block:
    __slots__ = ("text", "links", "dropped", "inside", "named", "article", "heading")

    def __init__(self, text: str, links: int, dropped: bool, inside: int, named: int = 0, article: int = 0,
                 heading: bool = False):
        self.text, self.links, self.dropped, self.inside = text, links, dropped, inside
        self.named = named  # the innermost element around it that a name drops (0: none)
        self.article = article  # the article element inside the content element that holds it (0: none)
        self.heading = heading


class Element:
    """An open element, and what holds for the text in it."""
    __slots__ = ("tag", "dropped", "inside", "link", "named", "why", "article", "heading")

    def __init__(self, tag="", dropped=False, inside=0, link=False, named=0, why=0, article=0, heading=False):
        self.tag, self.dropped, self.inside, self.link = tag, dropped, inside, link
        self.named, self.why, self.article, self.heading = named, why, article, heading


class Stack:
    """Open elements; knows without a search which tags are open, and the innermost block."""

    def __init__(self):
        self.open: list[Element] = [Element()]
        self.count: dict[str, int] = {}
        self.blocks: list[int] = []  # places of block-level elements

    def push(self, e: Element) -> None:
        if e.tag in BLOCK_TAGS:
            self.blocks.append(len(self.open))
        self.open.append(e)
        self.count[e.tag] = self.count.get(e.tag, 0) + 1

    def pop(self) -> Element:
        e = self.open.pop()
        self.count[e.tag] -= 1
        if self.blocks and self.blocks[-1] == len(self.open):
            self.blocks.pop()
        return e

    def cut(self, at: int) -> None:
        while len(self.open) > at:
            self.pop()


def blocks_of(html: str) -> tuple[list[Block], list[tuple[int, int]]]:
    """The blocks, and the elements that names drop: (number of the one around it, kind), from number 1 on."""
    out: list[Block] = []
    named: list[tuple[int, int]] = [(0, 0)]
    stack = Stack()
    parts: list[str] = []
    linked: list[str] = []
    contents = articles = 0

    def close() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                links = len(" ".join(unescape("".join(linked)).split())) if linked else 0
                top = stack.open[-1]
                out.append(Block(text, links, top.dropped, top.inside, top.named, top.article, top.heading))
            parts.clear()
            linked.clear()

    def add(text: str) -> None:
        top = stack.open[-1]
        if text and not top.dropped:
            parts.append(text)
            if top.link:
                linked.append(text)

    at = 0
    search = TOKEN.search
    while True:
        m = search(html, at)
        if m is None:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at:m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        block = tag in BLOCK_TAGS
        if tag == "br":
            add(" ")
        if m[1]:
            is_open = stack.count.get(tag, 0) > 0
            if block:
                close()
            while is_open:
                top = stack.open[-1]
                if top.tag in BLOCK_TAGS or top.why:
                    close()
                stack.pop()
                is_open = top.tag != tag
            continue
        if block:
            close()
            # An open paragraph, list item or cell ends where its like (or a block, for p) begins.
            if stack.blocks:
                name = stack.open[stack.blocks[-1]].tag
                if name == "p" or name == tag and tag in ("li", "dt", "dd", "option", "tr", "td", "th"):
                    stack.cut(stack.blocks[-1])
        if tag in VOID_TAGS:
            continue
        top = stack.open[-1]
        why = 0 if top.dropped else boilerplate(tag, m[3], top.inside)
        gone = top.dropped or why == SURE
        if why:
            close()
        if m[3].endswith("/") and tag not in BLOCK_TAGS and tag not in RAW_TAGS:
            continue
        e = Element(tag, gone, top.inside, top.link or tag == "a", top.named, why, top.article,
                    top.heading or tag in HEADINGS)
        if why and why != SURE:
            named.append((top.named, why))
            e.named = len(named) - 1
        if tag in CONTENT_TAGS and not gone and why != COMMENTS:
            if not e.inside:
                contents += 1
                e.inside = contents
            if tag == "article" and not e.article:
                articles += 1
                e.article = articles
        if tag in RAW_TAGS:
            end = RAW_TAGS[tag].search(html, at)
            if tag != "xmp":
                at = end.end() if end else len(html)
                continue
        stack.push(e)
    close()
    return out, named


def length(b: Block) -> int:
    """In letters of an alphabet: a Chinese, Japanese or Korean one stands for three."""
    return len(b.text) if b.text.isascii() else len(b.text) + 2 * len(DENSE.findall(b.text))


def stop_words(text: str) -> tuple[int, int]:
    """Stop words of the list that fits best, and all words."""
    words = LETTERS.findall(text.lower())
    counts = [0] * len(STOP_LISTS)
    for w in words:
        for i in STOP_WORDS.get(w, ()):
            counts[i] += 1
    return max(counts), len(words)


def prose_share(blocks: list[Block]) -> float:
    """The share of stop words in all blocks that may be prose by links and length."""
    stop = words = 0
    for b in blocks:
        if b.links <= len(b.text) * LINKS_OUTSIDE and length(b) >= LENGTH_LOW:
            n, m = stop_words(b.text)
            stop, words = stop + n, words + m
    return stop / max(1, words)


def prose_of(b: Block) -> int:
    """Its characters, if it may be prose by links and length."""
    return len(b.text) if b.links <= len(b.text) * LINKS_OUTSIDE and length(b) >= LENGTH_LOW else 0


def without_named(blocks: list[Block], named: list[tuple[int, int]]) -> list[Block]:
    """The blocks that no name drops.  Elements that hold all that is left of the page are not dropped by name.

    ``named`` is a tree: what an element holds is summed up from its children.
    """
    if not any(b.named for b in blocks):
        return blocks
    n = len(named)
    readers = [False] * n  # whether readers' comments are around it, itself included
    for x in range(1, n):
        readers[x] = readers[named[x][0]] or named[x][1] == COMMENTS
    article = any(b.inside for b in blocks if not b.named)
    size, own_size, content = [0] * n, [0] * n, [False] * n
    total = 0
    for b in blocks:
        own, prose = not readers[b.named], prose_of(b)
        total += prose if own else 0
        # Where an article is left, what stands outside it is no part of it.
        if b.inside or not article:
            size[b.named] += prose
            own_size[b.named] += prose if own else 0
        content[b.named] |= bool(b.inside) and own and not article
    for x in range(n - 1, 0, -1):
        around = named[x][0]
        size[around] += size[x]
        own_size[around] += own_size[x]
        content[around] |= content[x]
    kept = [True] * n
    for x in range(1, n):
        around, kind = named[x]
        own = content[x] or 2 * own_size[x] > total if kind == NAMED else size[x] and not total
        kept[x] = kept[around] and bool(own)
    return [b for b in blocks if kept[b.named]]


def without_teasers(blocks: list[Block]) -> list[Block]:
    """Where one article of several in a content element has most of its prose, the others go, with their headings."""
    size: dict[int, dict[int, int]] = {}
    for b in blocks:
        if b.inside:
            each = size.setdefault(b.inside, {})
            each[b.article] = each.get(b.article, 0) + prose_of(b)
    chief = {}
    for part, each in size.items():
        best = max((a for a in each if a), key=lambda a: each[a], default=0)
        if len([a for a in each if a]) > 1 and 2 * each[best] > sum(each.values()):
            chief[part] = best
    out: list[Block] = []
    after = False  # whether what comes next in the page is dropped
    for b in reversed(blocks):
        part = chief.get(b.inside, 0)
        if part and b.article and b.article != part or part and not b.article and b.heading and after:
            after = True
            continue
        after = False
        out.append(b)
    return out[::-1]


def first_pass(b: Block, has_content: bool, known: bool = True):
    """GOOD, BAD, OPEN (undecided) or PROSE (undecided but for its length), from the block alone;
    ``known``: whether stop words tell prose on this page."""
    if b.dropped or has_content and not b.inside:
        return BAD
    if b.links > len(b.text) * (LINKS_INSIDE if b.inside else LINKS_OUTSIDE):
        return BAD
    size = length(b)
    if size < LENGTH_LOW:
        return OPEN
    n, words = stop_words(b.text)
    stop = n / max(1, words)
    if stop >= STOP_HIGH:
        return GOOD if size > LENGTH_HIGH or b.inside else PROSE
    if b.inside:
        return OPEN
    if not known or not b.text.isascii() and 2 * len(UNLISTED.findall(b.text)) > len(b.text):
        return GOOD if size > LENGTH_HIGH else PROSE
    return OPEN if stop >= STOP_LOW else BAD


def join_runs(blocks: list[Block], labels: list) -> list:
    """PROSE becomes GOOD where the prose between two BAD blocks is long together, else OPEN;
    without any GOOD block, runs of undecided ones are."""
    n = len(blocks)
    runs, run = [], []
    for i in range(n):
        if run and (labels[i] == BAD or blocks[i].inside != blocks[run[0]].inside):
            runs.append(run)
            run = []
        if labels[i] != BAD:
            run.append(i)
    runs.append(run)
    out = [OPEN if x == PROSE else x for x in labels]
    for run in runs:
        prose = [i for i in run if labels[i] in (PROSE, GOOD)]
        if sum(length(blocks[i]) for i in prose) > LENGTH_HIGH:
            for i in prose:
                out[i] = GOOD
    if GOOD not in out:
        for run in runs:
            sizes = [length(blocks[i]) for i in run]
            if BAD not in out or max(sizes, default=0) >= LENGTH_LOW or sum(sizes) > LENGTH_HIGH:
                for i in run:
                    out[i] = GOOD
    return out


def second_pass(blocks: list[Block], labels: list) -> list[bool]:
    """Undecided blocks take the label of the nearest decided neighbour of their part of the page;
    of two as near, GOOD wins for blocks inside the content element, else BAD."""
    n = len(blocks)

    def sweep(order):
        out, last, where, part = [None] * n, None, -1, None
        for i in order:
            if blocks[i].inside != part:
                last, part = None, blocks[i].inside
            out[i] = (last, abs(i - where))
            if labels[i] is not OPEN:
                last, where = labels[i], i
        return out

    before, after = sweep(range(n)), sweep(range(n - 1, -1, -1))
    kept = []
    for i, (b, label) in enumerate(zip(blocks, labels)):
        if label is OPEN:
            (l, dl), (r, dr) = before[i], after[i]
            # Links inside an article say little about the text around them.
            if b.inside and GOOD not in (l, r):
                label = GOOD
            elif l == r or r is None:
                label = l
            elif l is None:
                label = r
            else:
                label = l if dl < dr else r if dr < dl else (GOOD if b.inside else BAD)
        kept.append(label == GOOD)
    return kept


def main_text(html: str | None) -> str:
    if not html:
        return ""
    blocks, named = blocks_of(html)
    blocks = without_teasers(without_named([b for b in blocks if not b.dropped], named))
    has_content = any(b.inside for b in blocks)
    known = has_content or prose_share(blocks) >= STOP_HIGH
    labels = [first_pass(b, has_content, known) for b in blocks]
    if not has_content:
        labels = join_runs(blocks, labels)
    return "\n".join(b.text for b, keep in zip(blocks, second_pass(blocks, labels)) if keep)


EXTRACTED = StructType([field("text", StringType()), field("n_chars", LongType())])


def extract_text(pages: DataFrame, html_col: str = "html", carry: list[str] | None = None) -> DataFrame:
    """Per row: ``row`` (the carried columns), text and n_chars (its code points)."""
    def make():
        def compute(batch):
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            return [texts, [len(t) for t in texts]]

        return compute

    return map_rows(with_row(pages, carry, html=html_col), EXTRACTED, "html", make)
