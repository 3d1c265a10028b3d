"""HTML extraction by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive unless an element around them is one that, on labelled pages,
mostly holds other things than the article; tags score negative, the more so the more of their kind stand outside the
article on labelled pages. One linear scan finds the contiguous run of highest score; its words of positive score, with
character references decoded and white space collapsed, are the text.

Each page is worked on alone, whole, in Arrow batches bounded by bytes. Contract: a null page is an empty one, and its text is
empty, as is that of a page without words; markup that is cut off is dropped; unclosed elements end with the element around
them; of equally good regions the first to end counts; repeated rows are worked on each on its own; an empty table gives an empty table; other columns stay unread.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, text_array

#: Comments, declarations, elements whose content is no markup, tags, and what a cut-off page ends with.
MARKUP = re.compile(
    r"""(<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?:script|style|textarea|noscript|template|iframe|svg)\b(?:[^>"']|"[^"]*"|'[^']*')*+>.*?(?:</(?:script|style|textarea|noscript|template|iframe|svg)\s*>|\Z)|</?[a-zA-Z](?:[^>"']|"[^"]*"|'[^']*')*+>|</?[a-zA-Z][^>]*(?:>|\Z))""",
    re.S | re.I,
)
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
OPAQUE = frozenset("script style textarea noscript template iframe svg".split())
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSED_BY_NEXT = frozenset("p li dt dd tr td th option".split())

#: Labelled pages: what stands between the two comments is the article. Weights are counted from these.
START, END = "<!--article-->", "<!--/article-->"
LABELLED = [
    "<html><head><title>Harbour walk</title><style>p{}</style><script>x()</script></head><body><header><h2>Town news daily site</h2></header><nav><ul><li><a>Home</a></li><li><a>Local</a></li><li><a>Sport</a></li><li><a>Contact</a></li></ul></nav><div class='ad'>Buy two lamps and get a third one free today</div>" + START + "<article><h1>Harbour walk opens</h1><p>The new walk along the harbour opened on <b>Monday</b> with music and a short speech by the mayor.</p><p>It took four years to build.<br>Visitors came from three towns.</p></article>" + END + "<footer>All rights reserved <a>Imprint</a></footer></body></html>",
    "<body><div id='menu'><ul><li><a>Start</a></li><li><a>Shop</a></li><li><a>Help</a></li></ul></div><div class='banner notice'>We use cookies to make this page better <button>Accept all</button></div><main>" + START + "<article><h1>How bread rises</h1><p>Yeast turns sugar into gas, and the gas is caught in the dough as many small bubbles.</p><h2>Time</h2><p>Cool dough rises slowly and tastes better.</p><blockquote>Be patient with it.</blockquote><ul><li>Flour</li><li>Water</li></ul></article>" + END + "</main><aside class='sidebar'><h3>Most read</h3><ul><li><a>Ten soups</a></li><li><a>Best knives</a></li></ul></aside><section class='comments'><h3>Comments</h3><div class='comment'><p>Great, worked at once for me!</p></div><div class='comment'><p>Mine stayed flat, what did I do wrong?</p></div></section><footer><p>Printed on recycled electrons since long ago</p></footer></body>",
    "<body><header><div class='logo'>The Gazette</div><form><input><label>Search the archive</label><button>Go</button></form></header><nav><a>World</a> <a>Money</a> <a>Weather</a></nav>" + START + "<article><h1>River level falls</h1><p>The river fell by two metres in a week, the <i>fastest</i> drop since records began.</p><p>Ships must wait for rain, said the port.</p></article>" + END + "<div class='promo advert'>Subscribe now for the price of one coffee a month</div><div class='related'><h3>More on this</h3><a>Dry summer</a> <a>Old bridges</a></div><div class='share social'><a>Mail</a> <a>Print</a></div><footer>Contact press office or read terms of use</footer></body>",
    "<body><nav><a>Blog</a> <a>Archive</a></nav><main class='content'>" + START + "<article><section><h2>Sharpening</h2><p>Hold the blade at a low angle and draw it slowly over the stone.</p></section><section><h2>Oil</h2><p>A drop is enough, wipe the rest away.</p></section></article>" + END + "</main><footer>Written by hand</footer></body>",
    "<body><div class='cookie popup'><p>This site stores cookies on your device as described in our policy.</p><button>Fine</button></div><div class='breadcrumb'><a>Home</a> <a>Garden</a></div><div>" + START + "<div><h1>Pruning roses</h1><p>Cut above a bud that looks outward, and take out crossing branches first.</p><p>Do it when the frosts are over.</p><table><tr><td>Shrub roses</td><td>March</td></tr></table></div>" + END + "<div class='ads'>Sharp secateurs with free delivery this week only</div><form class='newsletter'><p>Sign up for our weekly letter about plants</p><input><button>Join</button></form><div id='disqus' class='comments'><p>Thanks, very clear and short.</p></div><footer><ul><li><a>About</a></li><li><a>Jobs</a></li></ul></footer></div></body>",
]


def names_of(tag: str) -> list[str]:
    """Words of an element's class, id and role."""
    return [w.lower() for found in NAMED.findall(tag) for value in found if value for w in re.split(r"[^A-Za-z0-9]+", value) if w]


def units(page: str, weights: dict[str, float]):
    """(text, 0, worth) for text; (tag name, -1 or 1, worth) for tags, 1 for block tags; worth: the least weight of all elements around."""
    stack: list[tuple[str, float]] = []
    worth = 1.0
    for k, piece in enumerate(MARKUP.split(page)):
        if not k % 2:
            if piece:
                yield piece, 0, worth
            continue
        found = TAG.match(piece)
        if not found:
            continue
        name = found[2].lower()
        if name in OPAQUE:
            yield name, 1, worth
            continue
        if found[1]:
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][0] == name:
                    worth = stack[at][1]
                    del stack[at:]
                    break
        elif name not in VOID and not piece.endswith("/>"):
            if name in CLOSED_BY_NEXT and stack and stack[-1][0] == name:
                worth = stack.pop()[1]
            stack.append((name, worth))
            own = weights.get(name, 1.0)
            if "=" in piece:
                own = min([own, *(weights.get(f".{w}", 1.0) for w in names_of(piece))])
            worth = min(worth, own)
        yield name, -1 if name in INLINE else 1, worth


@lru_cache(1)
def weights_of(pages: tuple[str, ...] = tuple(LABELLED)) -> tuple[dict[str, float], dict[str, float]]:
    """(weight of words by element or class, weight of tags), from labelled pages."""
    inside, outside, tags_in, tags_out = Counter(), Counter(), Counter(), Counter()
    for page in pages:
        head, rest = page.split(START)
        body, tail = rest.split(END)
        stack: list[list[str]] = []
        for part, words, tags in ((head, outside, tags_out), (body, inside, tags_in), (tail, outside, tags_out)):
            for k, piece in enumerate(MARKUP.split(part)):
                if not k % 2:
                    for key in {key for keys in stack for key in keys}:
                        words[key] += len(piece.split())
                    continue
                if found := TAG.match(piece):
                    name = found[2].lower()
                    tags[name] += 1
                    if found[1]:
                        while stack and stack.pop()[0] != name:
                            pass
                    elif name not in VOID | OPAQUE:
                        stack.append([name, *(f".{w}" for w in names_of(piece))])
    # Words around which an element stands that never holds article text count a little against a region, others one each.
    of_words = {k: max(-0.2, -math.log((n + 0.5) / 0.5) / 10) for k, n in outside.items() if not inside[k] and k not in INLINE | CLOSED_BY_NEXT and not re.fullmatch("h[1-6]", k)}
    of_tags = {k: -0.1 * math.log(1 + (tags_out[k] + 0.5) / (tags_in[k] + 0.5)) for k in tags_in | tags_out}
    return of_words, of_tags


def best_region(scores: list[float]) -> tuple[int, int]:
    """(begin, end) of the contiguous run of highest sum, end exclusive; of equally good ones the one that ends first, and of these the shortest. (0, 0) if no run is above zero."""
    best, span, total, begin = 0.0, (0, 0), 0.0, 0
    for k, score in enumerate(scores):
        total += score
        if total <= 0:
            total, begin = 0.0, k + 1
        elif total > best:
            best, span = total, (begin, k + 1)
    return span


def scored(page: str) -> tuple[list[tuple[str, int, float]], list[float]]:
    """The page's words and tags, and the score of each."""
    of_words, of_tags = weights_of()
    seen = list(units(page, of_words))
    return seen, [of_tags.get(what, -0.1) if kind else worth * len(what.split()) for what, kind, worth in seen]


def main_text(page: str) -> str:
    seen, scores = scored(page)
    kept = [(" " if kind > 0 else "") if kind else html.unescape(what) if worth > 0 else " " for what, kind, worth in seen[slice(*best_region(scores))]]
    return " ".join("".join(kept).split())


def extract(pages: DataFrame, page: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, url, text, n_chars) for every row."""

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, "html", 4 << 20):
                texts = [main_text(x) for x in text_array(part.column("html")).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["key", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (key, url)]
    out = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(page).alias("html")).mapInArrow(run, f"key {kinds[0]}, url {kinds[1]}, text string, n_chars long")
    return out.withColumnsRenamed({"key": key, "url": url})
