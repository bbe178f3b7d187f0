"""Main-text extraction from HTML by a maximum-scoring subsequence.

A page becomes a sequence of tags and words. Tags cost; a word earns the log odds of its block being content, as
counted on labelled pages (LABELLED, and pages made by rule without class names). Two things speak for or
against a block: the signs of the containers around it (tag names; whole class, id and role words; parts of compound
ones, which are signs of their own), where the nearest container whose signs sum to a clear answer decides, and the
block itself (its tag, its number of words, how many are links, whether it ends like a sentence). One linear scan finds
the contiguous run with the greatest sum. Of that run, blocks whose own containers speak against them (adverts, forms,
comments inside the article) are left out. Where class words leave nothing of a page that has words, the scan is
repeated without them, and then with nothing but links to tell words apart, so no class word empties a page.

Defined results: a null, empty or wordless page gives the empty string; script, style, template and similar raw
elements and HTML comments are never text; of equally good runs the first counts, and the longer if both begin
alike. White space inside a block becomes one space, blocks join by one newline. Very long pages take time that grows
with their length; rows that repeat or share a page_id each have their result; other columns, whatever their names,
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame, functions as F

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_RAW = frozenset("script style template noscript svg iframe object textarea title select".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Tags whose names say nothing of what they hold.
_PLAIN = _INLINE | frozenset("html body div section p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption pre blockquote figure figcaption center details summary hgroup".split())
_ARTICLE = frozenset("article main".split())
_ENTRY = frozenset("article entry post".split())  # class words of an article, as in entry-header

#: Pages whose content is known; `text` holds what is content, line by line.
LABELLED = [
    ("<body><header><h1>Site</h1><p>The daily site about everything</p></header><nav><ul><li><a href=/a>Home page</a></li><li><a href=/b>All news</a></li></ul></nav><main><article><h1>A headline</h1><p>First words of the story, told at length.</p><p>Second words of the story.</p><ul><li>one point</li></ul><blockquote><p>said someone</p></blockquote></article></main><aside class=sidebar><h3>More</h3><p>Read these other stories as well</p></aside><footer><p>Copyright by the site, all rights reserved</p></footer></body>",
     "A headline\nFirst words of the story, told at length.\nSecond words of the story.\none point\nsaid someone"),
    ("<body><div class=menu><a href=/>Start</a><a href=/x>Shop now</a></div><div class='content post'><h2>On tea</h2><p>Tea is brewed from leaves.</p><div class=ad>Buy our cheap tea today</div><p>It is drunk warm.</p></div><div class=comments><h3>Comments</h3><p>I like tea very much myself</p></div><div id=footer>Contact us at the office</div></body>",
     "On tea\nTea is brewed from leaves.\nIt is drunk warm."),
    ("<body><div class='cookie notice'><p>We use cookies on this site to serve you</p><button>Accept all of them</button></div><div role=navigation><a href=/1>First</a><a href=/2>Second</a></div><section class=article-body><h1>Rivers</h1><p>A river runs to the sea.</p><table><tr><td>length in miles</td></tr></table><pre>the raw numbers</pre></section><form><label>Your name please</label><input><button>Send it</button></form><div class='advert banner'>Ten for the price of nine</div><div class=breadcrumbs>Home and then rivers</div></body>",
     "Rivers\nA river runs to the sea.\nlength in miles\nthe raw numbers"),
    ("<body><div id=header>The forum of the town</div><div class=sidebar><ul><li><a href=/t>Tags</a></li><li><a href=/u>Users here</a></li></ul></div><div id=main class=entry><h1>Bread</h1><p>Flour, water, salt and time.</p><h2>Baking</h2><p>Heat the oven well.</p><dl><dt>crumb</dt><dd>the soft inside</dd></dl><div class='share social'>Share this with friends now</div></div><div class='related links'><a href=/r>Related things to read</a></div><div id=disqus class=comment-list><div class=comment>Great bread you made there</div><div class=reply>Thank you very much</div></div><footer class=site-footer><small>Terms and privacy</small></footer></body>",
     "Bread\nFlour, water, salt and time.\nBaking\nHeat the oven well.\ncrumb\nthe soft inside"),
    ("<body><div class='popup modal newsletter'><p>Subscribe to our letter for more</p></div><div class=promo>Only today, half price</div><div class=sponsored>A word from those who pay</div><div class='pagination pager'><a href=/p2>Next page</a></div><div class=text><p>Plain pages have plain text.</p><figure><figcaption>a plain picture</figcaption></figure></div><div class=widget>Weather in your town</div><div class='alert banner'>The office closes early</div><div class=copyright>Nobody may copy this</div><div class=login>Sign in to go on</div></body>",
     "Plain pages have plain text.\na plain picture"),
    ("<body class=home><div id=page class='site wrapper container'><header class=site-header><p>The gazette of the valley</p><nav><a href=/>All the issues</a></nav></header><div class='site-content wrap'><main class=site-main><article><header class=entry-header><h1>Bees come back to the valley in the first warm days of spring</h1></header><div class=entry-content><p>The <a href=/r>report of the keepers</a> says that <small>as a rule</small> bees <b>fly</b> from March on.</p><p><a href=/s>A line that is one link</a></p></div><footer><p>Filed under insects</p></footer></article></main></div><footer class=site-footer>All rights stay with the valley</footer></div></body>",
     "Bees come back to the valley in the first warm days of spring\nThe report of the keepers says that as a rule bees fly from March on.\nA line that is one link"),
    ("<body><div class='page outer container wrapper site'><div class=header>The stone journal</div><div role=navigation><a href=/s>All of our stones</a> <a href=/t>Every tool that we have</a></div><article><div class='header article-header'><h1>How walls were built without any mortar in the hills</h1><p>They still stand today</p></div><section class=article-body><p>Stones were laid by <a href=/w>wallers</a> in two faces, and the gap was filled.</p></section><aside>Seen by others too</aside></article><div class='related links'><p>Other readers went on to these pages about slate, lime, sand and the tools of the trade</p></div></div></body>",
     "How walls were built without any mortar in the hills\nThey still stand today\nStones were laid by wallers in two faces, and the gap was filled."),
    ("<body><div id=gdpr class='gdpr-banner consent'><p>This site keeps your choices for a year</p></div><div class='masthead topbar'>The paper of the coast</div><article><h1>Salt is won from the sea</h1><p>The pans are filled at high tide and left to dry.</p><div class='newsletter-signup subscribe'>Have our letter sent to your door</div><p>After a month the salt is raked.</p></article><section id=discussion class=discussion><h3>What readers said</h3><div class=thread-reply><p>My uncle worked in these pans for years</p></div></section><div class='colophon legal'>Printed by the harbour office</div></body>",
     "Salt is won from the sea\nThe pans are filled at high tide and left to dry.\nAfter a month the salt is raked."),
    ("<body><div class='toolbar search-box'>Look for a word here</div><div class='toast notification'>You have two new messages today</div><main><h1>How clocks keep time</h1><p>A weight falls slowly and turns the wheels.</p><div class='outbrain recommended'>Seven clocks that you should see</div><p>The pendulum lets one tooth pass at each swing.</p><div class='responses'><h3>Two responses</h3><p>I have one of these in the hall</p></div><div class=replies><p>Mine stopped in the winter of last year</p></div></main><div class='trending popular'>Most read this week by all</div><div class='overlay dialog'>Stay and read one more page</div><div class='feedback'>Tell us what you thought of it</div><div class='disclaimer'>No warranty of any kind is given</div><div class='reader-replies'>A fine piece, many thanks to you</div><div class='visitor-feedback'>Was this of any use to you</div><div class='privacy-consent cookie-wall'>Choose what we may keep of you</div><div class='toast-message overlay-box'>Your choice was kept for now</div><div class='reader-discussion'>So what do you make of it</div><div class='all-responses'>Nine people have had their say here</div></body>",
     "How clocks keep time\nA weight falls slowly and turns the wheels.\nThe pendulum lets one tooth pass at each swing."),
]


class _Container:
    """An open element with signs, and the nearest such one around it; blocks share these by reference."""

    __slots__ = ("own", "up")

    def __init__(self, own: tuple[str, ...], up: "_Container | None"):
        self.own, self.up = own, up

    def all_signs(self) -> set[str]:
        out, at = set(), self
        while at is not None:
            out.update(at.own)
            at = at.up
        return out


class _Open:
    """An element that is open: what it is inside of, so that no text has to look through all of its ancestors."""

    __slots__ = ("name", "container", "linked", "tag", "article", "p")

    def __init__(self, name: str, place: int, own: tuple[str, ...], up: "_Open | None"):
        self.name = name
        self.container = _Container(own, up and up.container) if own else up and up.container
        self.linked = name == "a" or bool(up and up.linked)
        self.tag = name if name not in _INLINE else up.tag if up else ""  # of the block
        self.article = name in _ARTICLE or bool(up and up.article)
        self.p = place if name == "p" else up.p if up and name in _INLINE else -1  # the open p that a block would close


def _signs(name: str, attributes: str, inside: bool) -> tuple[str, ...]:
    """Signs of a tag, inside an article or not; html and body have none."""
    if name in ("html", "body"):
        return ()
    words: list[str] = []
    for _, value in _ATTRIBUTE.findall(attributes):
        for word in re.sub(r"([a-z])([A-Z])", r"\1-\2", value.strip("\"'")).lower().split():
            parts = re.findall(r"[a-z]+", word)
            words += [f".{p}" for p in parts] if len(parts) == 1 else [f"-{p}" for p in parts]
    inside = inside or any(w[1:] in _ENTRY for w in words)
    signs = [] if name in _PLAIN else [name]
    signs += words
    return tuple(f"{s} in article" if inside and s.lstrip(".-") in ("header", "footer") else s for s in signs)


def sequence(page: str) -> list[tuple]:
    """Tags and text in page order: ("tag", inline) or ("text", block, text, container, whether linked, tag of the block)."""
    out, block, at = [], 0, 0
    stack: list[_Open] = []
    opened: dict[str, int] = {}  # how many of each name are open

    def put(text):
        if text:
            out.append(("text", block, text, stack[-1].container, stack[-1].linked, stack[-1].tag) if stack else ("text", block, text, None, False, ""))

    def leave(place):
        for x in stack[place:]:
            opened[x.name] -= 1
        del stack[place:]

    for m in _TAG.finditer(page):
        if m.start() < at:
            continue
        put(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        close = bool(m[1])
        if name not in _INLINE:
            block += 1
        out.append(("tag", name in _INLINE))
        if close:
            if opened.get(name):
                i = len(stack) - 1
                while stack[i].name != name:
                    i -= 1
                leave(i)
            continue
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            block += 1
            continue
        if name in _VOID or re.search(r"(?:^|[\s\"'])/\s*$", m[3]):  # not the end of an address, as in href=/
            continue
        if name in _CLOSES_P and stack and stack[-1].p >= 0:
            leave(stack[-1].p)
        up = stack[-1] if stack else None
        stack.append(_Open(name, len(stack), _signs(name, m[3], bool(up and up.article)), up))
        opened[name] = opened.get(name, 0) + 1
    put(page[at:] if not re.match(r"<[A-Za-z/!]", page[at:]) else "")
    return out


def _clean(text: str) -> str:
    return " ".join(html.unescape(text).split())


def _kinds(blocks: dict[int, list]) -> dict[int, tuple[str, ...]]:
    """What each block (its pieces of text, as in sequence) is like, as signs."""
    out = {}
    for block, pieces in blocks.items():
        words = sum(len(x[2].split()) for x in pieces)
        linked = sum(len(x[2].split()) for x in pieces if x[4])
        text = "".join(x[2] for x in pieces).rstrip()
        tag = pieces[0][5] if pieces[0][5] in _TEXT_TAGS else "other"
        size = "1" if words < 2 else "2-4" if words < 5 else "5-11" if words < 12 else "12-29" if words < 30 else "30+"
        out[block] = (f"tag {tag}", f"words {size}", "linked" if linked * 2 > words else "some links" if linked else "no links", "sentence" if text.endswith((".", "!", "?", ":", "\"", ";")) else "no sentence")
    return out


def _blocks(items: list[tuple]) -> dict[int, list]:
    out: dict[int, list] = {}
    for x in items:
        if x[0] == "text" and x[2].strip():
            out.setdefault(x[1], []).append(x)
    return out


_TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li td th dd dt pre blockquote figcaption".split())


def made_pages(n: int = 60, start: int = 5, named: bool = False) -> list[tuple[str, str]]:
    """Labelled pages made by rule, without class names or (named) with ones that mean nothing; another start makes others."""
    import random

    rng = random.Random(start)
    word = lambda: "".join(rng.choice("abdegiklmnoprstuv") for _ in range(rng.randint(2, 9)))
    some = lambda lo, hi: " ".join(word() for _ in range(rng.randint(lo, hi)))
    sentence = lambda lo, hi: some(lo, hi).capitalize() + rng.choice("...!?")
    box = lambda inner: f"<div class={word()}>{inner}</div>" if named else f"<div>{inner}</div>"
    link = lambda lo, hi: f"<a href=/{word()}>{some(lo, hi)}</a>"

    def around():
        return rng.choice(
            [
                lambda: box("<ul>" + "".join(f"<li>{link(1, 3)}</li>" for _ in range(rng.randint(3, 9))) + "</ul>"),
                lambda: box(" ".join(link(1, 2) for _ in range(rng.randint(3, 7)))),
                lambda: box(f"<h3>{some(1, 3)}</h3>" + "".join(f"<p>{link(3, 9)}</p>" for _ in range(rng.randint(2, 5)))),
                lambda: box(f"<span>{some(1, 3)}</span> <span>{some(1, 4)}</span>"),
                lambda: box(some(3, 9)),
                lambda: box("".join(f"<div>{some(1, 4)}</div>" for _ in range(rng.randint(2, 4)))),
            ]
        )()

    pages = []
    for _ in range(n):
        text, body = [], []
        title = some(3, 10)
        parts = [("h1", title)]
        for _ in range(rng.randint(2, 7)):
            parts.append(rng.choice([("p", " ".join(sentence(4, 18) for _ in range(rng.randint(1, 6)))), ("p", sentence(8, 30)), ("p", sentence(1, 6)), ("div", sentence(8, 30)), ("h2", some(1, 5)), ("li", some(2, 9)), ("li", sentence(2, 9))]))
        parts.append(("p", sentence(6, 20)))
        for tag, said in parts:
            text.append(said)
            first, _, rest = said.partition(" ")
            inner = f"<a href=/{word()}>{first}</a> {rest}" if rest and rng.random() < 0.15 else said
            body.append(f"<{tag}>{inner}</{tag}>" if tag != "li" else f"<ul><li>{inner}</li></ul>")
        before, after = ("".join(around() for _ in range(rng.randint(1, 3))) for _ in range(2))
        pages.append((f"<body>{before}{box(''.join(body))}{after}</body>", "\n".join(text)))
    return pages


def fit(pages=None) -> dict[str, float]:
    """Log odds of content for each sign, per word, from pages with known content."""
    good: dict[str, float] = {}
    bad: dict[str, float] = {}
    total = [0, 0]
    for page, text in [*LABELLED, *made_pages()] if pages is None else pages:
        content = set(text.split("\n"))
        blocks = _blocks(sequence(page))
        kinds = _kinds(blocks)
        for block, pieces in blocks.items():
            said = _clean("".join(x[2] for x in pieces))
            words = min(len(said.split()), 12)  # so that long blocks do not speak alone
            counts = good if said in content else bad
            total[said not in content] += words
            for s in {*kinds[block], *(s for x in pieces if x[3] for s in x[3].all_signs())}:
                counts[s] = counts.get(s, 0) + words
    base = math.log(total[0] / total[1])
    return {s: math.log((good.get(s, 0) + 1) / (bad.get(s, 0) + 1)) - base for s in good | bad}


TAG_COST, INLINE_COST, WORD = 0.6, 0.1, 0.5
CLEAR = 1.0  # sum of log odds from which a container decides
AGAINST = -0.2  # a word that its containers speak against costs this at most: such blocks are left out of the run anyway
MOST, LOSS = 1.5, 0.3  # a word earns or loses this at most by its block alone: a short line inside an article cuts nothing off


def _worth(at: _Container | None, weights: dict[str, float], tags: bool, known: dict) -> float | None:
    """What the nearest container says whose signs (or only tags) sum to a clear answer; None if there is none."""
    asked = []
    while at not in known:
        told = sum(weights.get(s, 0.0) for s in at.own if not tags or s[0] not in ".-")
        if abs(told) >= CLEAR:
            known[at] = told
            break
        asked.append(at)
        at = at.up
    for x in asked:
        known[x] = known[at]
    return known[at]


def scored(items: list[tuple], weights: dict[str, float], signs: str = "all") -> tuple[list[float], dict]:
    """What each item earns, and what its containers say: all of their signs, only their tags, or (links) only whether words are links."""
    kinds = _kinds(_blocks(items))
    if signs == "links":
        alone = {b: -CLEAR if "linked" in k else WORD for b, k in kinds.items()}
    else:
        alone = {b: max(-LOSS, min(MOST, sum(weights.get(s, 0.0) for s in k))) for b, k in kinds.items()}
    known: dict[_Container | None, float | None] = {None: None}
    score = []
    for x in items:
        if x[0] == "tag":
            score.append(-INLINE_COST if x[1] else -TAG_COST)
            continue
        w = None if signs == "links" else _worth(x[3], weights, signs == "tags", known)
        w = alone.get(x[1], 0.0) if w is None else WORD + w if w > 0 else max(w, AGAINST)
        score.append(w * len(x[2].split()))
    return score, known


def best_run(score: list[float]) -> tuple[int, int]:
    """The contiguous run of the greatest sum, as (start, end); (0, 0) if no sum is over 0."""
    best, lo, hi, start, run = 0.0, 0, 0, 0, 0.0
    for i, s in enumerate(score):
        if run <= 0:
            start, run = i, 0.0
        run += s
        if run > best or run == best and start == lo and best:
            best, lo, hi = run, start, i + 1
    return lo, hi


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The main text of one page, block by block."""
    items = sequence(page) if page else []
    if not any(x[0] == "text" and _clean(x[2]) for x in items):
        return ""
    for signs in ("all", "tags", "links"):
        score, known = scored(items, weights, signs)
        lo, hi = best_run(score)
        blocks: dict[int, list[str]] = {}
        for x in items[lo:hi]:
            if x[0] == "text" and not (known.get(x[3]) or 0.0) < 0:
                blocks.setdefault(x[1], []).append(x[2])
        text = "\n".join(t for parts in blocks.values() if (t := _clean("".join(parts))))
        if text:
            return text
    return ""


def _run(weights):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [main_text(p, weights) for p in batch.column("html").to_pylist()]
            kept = [batch.column(c) for c in batch.schema.names if c != "html"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], [*(c for c in batch.schema.names if c != "html"), "text", "n_chars"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_run(fit()), "page_id long, url string, text string, n_chars long")
