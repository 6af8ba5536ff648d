"""Main text of web pages: flat text blocks, classified by a decision tree over their own and their neighbours' shape.

A page is cut into blocks at block-level tags. A block's features are its words and link density, those of the blocks before
and after it, whether it lies in the page's article element and whether the page has one, and how strongly the nearest
container around it names itself navigation, advert, notice, form, comments and the like (0, 1 for kinds that may also hold
an article, 2). The tree is grown (Gini, axis-parallel cuts) on the blocks of the labelled example pages below or on a table
that the caller gives, and its leaves say whether a block belongs to the article.

A container's name counts for what lies in it, up to an article or main element inside it or a container that names itself
content; an article element under such a name counts as one only where the page has no other (readers' comments are often
marked up as articles).

Defined results: a null or empty html has an empty text; a page in which no block is taken has an empty text; repeated pages
keep all their rows, and so do pages with a null page_id; broken markup is read as a browser would, declarations that are
none as comments; very long pages are read whole and nothing is capped; ties in growing the tree go to the earlier feature
and the lower cut; an empty table gives none; other columns are not looked at.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ammolite.llm.common import ensure_columns

FEATURES = ("words", "density", "prev_words", "prev_density", "next_words", "next_density", "inside_main", "aside", "page_has_main")

# HTML elements by the part they play.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture source".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title textarea select option button svg math iframe object canvas audio video".split())
MAIN = frozenset("article main".split())
ASIDE = {"nav": 2, "footer": 2, "menu": 2, "dialog": 2, "aside": 2, "form": 1, "fieldset": 1}
#: Words in class, id or role that name a part which is not the article, those that may hold one, and those that take such a name back.
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsbox banner promo sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget related recommended share sharing social footer masthead comment comments respond disqus replies reply toolbar pagination pager skip copyright legal "
    "complementary contentinfo".split()
)
WEAK_NAMES = frozenset("search form results list".split())
CONTENT_NAMES = frozenset("content article post entry story body main wrapper container layout site with has no without".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Labelled example pages: {n} stands for n words that belong to the article, [n] for n that don't.
EXAMPLES = [
    # an article element among menus, adverts and a footer; short paragraphs, lists and a quoted link in it
    "<nav><ul><li><a>[1]</a></li><li><a>[2]</a></li><li><a>[1]</a></li></ul></nav><div class=ad>[9]</div><article><h1>{6}</h1><p>{80}</p><p>{3}</p><div class=ad>[14]</div><p>{40} <a>{4}</a></p><ul><li>{5}</li><li>{12}</li></ul><p>{1}</p></article><footer>[10]</footer>",
    "<header>[4]</header><div class=sidebar><p>[30]</p><p>[22]</p></div><article><p>{1}</p><p>{2}</p><p><a>{6}</a></p><p>{300}</p></article><div class=comments><p>[60]</p><p>[25]</p></div><footer><a>[3]</a><a>[2]</a></footer>",
    "<div>[8]</div><p>[45]</p><main><h2>{3}</h2><p>{15}</p><p><a>{7}</a> {5}</p><section class=comments><p>[70]</p><p>[12]</p></section></main><p>[90]</p><div><a>[2]</a></div>",
    "<form><article><p>{50}</p><p>{7}</p></article><p>[2]</p></form><p>[130]</p><p>[20]</p>",
    "<div>[40]</div><div>[7]</div><article><h1>{9}</h1><p>{1}</p><p>{2}</p><p><a>{3}</a></p><p>{4}</p><div class=ad>[2]</div><p>{6}</p><div class=ad>[60]</div><p>{2}</p></article><p>[3]</p><p>[75]</p><p><a>[2]</a></p>",
    "<article><p><a>{5}</a></p><p><a>{1}</a></p><p>{2}</p><ul><li><a>{9}</a></li><li><a>{30}</a></li><li>{2} <a>{2}</a></li></ul></article><p>[33]</p><p>[2]</p><p>[8]</p><p>[200]</p>",
    "<p>[5]</p><div>[28]</div><article><h2>{2}</h2><p>{4}</p><h2>{1}</h2><p>{3}</p><p>{70}</p><h3>{2}</h3></article><div>[5]</div><div class=ad>[1]</div><p>[11]</p><p>[52]</p>",
    "<div class=comments><p>[40]</p></div><article><p>{44}</p><form><p>[3]</p><p>[9]</p><p>[30]</p></form><p>{2}</p><div class=related><a>[5]</a><p>[55]</p></div><p>{150}</p><p>{95}</p></article><form><p>[12]</p></form><p>[85]</p>",
    "<p>[6]</p><p>[1]</p><article><p>{8}</p><p>{64}</p><p>{18}</p><p>{1}</p><p>{7} <a>{3}</a></p><p>{12}</p><p>{26}</p><p>{2}</p><p>{3}</p><p>{5}</p></article><p>[150]</p><p>[64]</p><p>[15]</p>",
    # no such element: long blocks of few links, and the short ones among them
    "<div><a>[3]</a></div><div><a>[2]</a></div><div><a>[4]</a></div><h2>{5}</h2><p>{70}</p><p>{45}</p><p>{9}</p><p>{60} <a>{6}</a></p><div><a>[3]</a></div><div>[4] <a>[3]</a></div><div>[3]</div>",
    "<td><a>[2]</a></td><td><a>[3]</a></td><td>{90}</td><td>{33}</td><td>{6}</td><td>{110}</td><td>{24}</td><td><a>[5]</a></td><td><a>[1]</a></td><td>[5]</td>",
    "<p>{40}</p><ul><li><a>[8]</a> [2]</li><li><a>[9]</a> [1]</li><li><a>[12]</a> [4]</li><li><a>[7]</a></li></ul><p>[2]</p>",
    "<div><a>[1]</a></div><h1>{4}</h1><p>{22}</p><p>{19}</p><p>{55}</p><p>{8}</p><div class=comments><p>[50]</p><p>[30]</p><p>[80]</p></div><div><a>[2]</a> [1]</div>",
    "<p>{120}</p><p>{35}</p><div class=sidebar><h3>[2]</h3><p>[18]</p><p>[64]</p></div><div class=cookie>[35]</div><div>[2]</div><div><a>[2]</a></div>",
    "<div><a>[6]</a></div><p>[30] <a>[60]</a></p><div><a>[9]</a></div><h2>{7}</h2><p>{85}</p><p>{64}</p><p>{5}</p>",
    "{14}", "<p>{9}</p>", "<div>{25}</div>", "<p>{11} <a>{2}</a></p>", "<div><a>[3]</a></div>", "<p>{16}</p><p>{13}</p>",
    # forms and lists: labels and links, or a whole article in an odd place
    "<form><p>[2]</p><p>[3]</p><p>[6]</p><p>[4]</p></form><p>{75}</p><p>{48}</p><div>[3]</div><div><a>[2]</a></div>",
    "<div class=search><h2>{5}</h2><p>{50}</p><p>{80}</p><p>{65}</p><p>{28}</p></div><div><a>[2]</a></div><div>[2]</div>",
    "<div class=search><p>[4]</p><p><a>[6]</a></p><p><a>[9]</a> [3]</p></div><p>{58}</p><p>{26}</p><div><a>[3]</a></div><div>[4]</div>",
]


def labelled_rows(pages: list[str] = EXAMPLES) -> list[tuple]:
    """The small labelled table: the features of every block of the example pages, then 1 for those of the article."""
    filled = [re.sub(r"([{\[])(\d+)[}\]]", lambda m: " ".join(["kept" if m[1] == "{" else "left"] * int(m[2])), x) for x in pages]
    return [(*row, int(text.startswith("kept"))) for x in filled for text, row in zip(*block_rows(x))]


def grow(rows: list[tuple], depth: int = 6, least: int = 1):
    """A binary tree: (feature, cut, below, above), or a leaf's label. Ties go to the earlier feature and the lower cut."""
    ones = sum(r[-1] for r in rows)
    label = int(2 * ones >= len(rows))
    if depth == 0 or ones in (0, len(rows)):
        return label
    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for lo, hi in zip(values, values[1:]):
            cut = (lo + hi) / 2
            low = [r for r in rows if r[f] <= cut]
            a, n = sum(r[-1] for r in low), len(low)
            b, m = ones - a, len(rows) - n
            if min(n, m) < least:
                continue
            impurity = a * (n - a) / n + b * (m - b) / m
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, cut)
    if best is None or best[0] >= ones * (len(rows) - ones) / len(rows) - 1e-12:
        return label
    _, f, cut = best
    return f, cut, grow([r for r in rows if r[f] <= cut], depth - 1, least), grow([r for r in rows if r[f] > cut], depth - 1, least)


def decide(tree, row: tuple) -> int:
    while isinstance(tree, tuple):
        f, cut, low, high = tree
        tree = low if row[f] <= cut else high
    return tree


class Blocks(HTMLParser):
    """Collects (text, words, words in links, inside main, nearest aside, any aside above) of each block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int, int, int, int]] = [("", 0, 0, 0, 0, 0)]  # tag, silent, main, aside, any aside above, link
        self.parts: list[tuple[str, int]] = []
        self.blocks: list[tuple[str, int, int, int, int, int]] = []
        self.has_main = 0

    def parse_marked_section(self, i, report=1):
        """<![...]> is no HTML: a comment up to the next sign that ends a tag."""
        end = self.rawdata.find(">", i + 3)
        return -1 if end < 0 else end + 1

    def handle_starttag(self, tag, attrs):
        inline = tag in INLINE
        if not inline:
            self.cut()
        if tag in VOID:
            return
        if tag == "p" or tag == "li":  # an open one of the same kind ends here
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k][0] == tag:
                    del self.stack[k]
                    break
                if self.stack[k][0] not in INLINE:
                    break
        _, silent, main, aside, above, link = self.stack[-1]
        named, content, article = ASIDE.get(tag, 0), False, tag in MAIN
        if tag in SILENT:
            silent = 1
        elif tag == "header" and not main:
            named = 2
        elif tag == "a":
            link = 1
        for name, value in attrs:
            if name in ("class", "id", "role") and value and tag not in ("html", "body"):
                words = set(re.split(r"[^a-z0-9]+", value.lower()))
                content = content or not CONTENT_NAMES.isdisjoint(words)
                named = max(named, 0 if not CONTENT_NAMES.isdisjoint(words) else 2 if not ASIDE_NAMES.isdisjoint(words) else int(not WEAK_NAMES.isdisjoint(words)))
                article = article or name == "role" and value.lower() in MAIN
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and HIDDEN.search(value):
                silent = 1
        if article:
            main = self.has_main = 1
        aside = max(named, 0 if article or content else aside)
        self.stack.append((tag, silent, main, aside, max(above, aside), link))

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.cut()
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                if tag in INLINE and any(x[0] not in INLINE for x in self.stack[k + 1 :]):
                    del self.stack[k]  # misnested: only the inline element itself ends
                else:
                    del self.stack[k:]
                return

    def handle_data(self, data):
        top = self.stack[-1]
        if not top[1]:
            self.parts.append((data, top[5]))

    def cut(self):
        if self.parts:
            words = "".join(x for x, _ in self.parts).split()
            if words:
                linked = sum(len(x.split()) for x, link in self.parts if link)
                _, _, main, aside, above, _ = self.stack[-1]
                self.blocks.append((" ".join(words), len(words), min(linked, len(words)), main, aside, above))
            self.parts = []

    def handle_startendtag(self, tag, attrs):
        if tag not in INLINE:
            self.cut()


def block_rows(html: str) -> tuple[list[str], list[tuple]]:
    """The texts and the features of a page's blocks."""
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser.cut()
    found = parser.blocks
    # articles under an aside's name are the article only where there is no other
    other = any(main and not above for _, _, _, main, _, above in found)
    shape = [(0, 0.0), *((n, linked / n) for _, n, linked, *_ in found), (0, 0.0)]
    rows = [(*shape[i + 1], *shape[i], *shape[i + 2], main, above if main and other else aside, parser.has_main) for i, (_, _, _, main, aside, above) in enumerate(found)]
    return [x[0] for x in found], rows


def main_text(html: str | None, tree) -> str:
    if not html:
        return ""
    texts, rows = block_rows(html)
    return " ".join(t for t, r in zip(texts, rows) if decide(tree, r))


def extract(pages: DataFrame, labelled: list[tuple] | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page. `labelled` rows are the features in the order of FEATURES, then 1 for blocks of the article."""
    tree = grow(labelled_rows() if labelled is None else labelled)

    def run(batches):
        for b in batches:
            html = b.column(2).to_pylist()
            for lo in range(0, len(html), 500):
                texts = [main_text(x, tree) for x in html[lo : lo + 500]]
                yield pa.record_batch([b.column(0).slice(lo, len(texts)), b.column(1).slice(lo, len(texts)), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return ensure_columns(pages, page_id="long", url="string", html="string").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
