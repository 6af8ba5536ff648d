import html
import random
import re

from ammolite.llm import page_text

from ..oracle import SF

TREE = page_text.grow(page_text.labelled_rows())


def leaves(tree):
    return [] if not isinstance(tree, tuple) else [page_text.FEATURES[tree[0]], *leaves(tree[2]), *leaves(tree[3])]


def test_tree_weighs_words_density_and_neighbours():
    used = set(leaves(TREE))
    assert {"words", "density", "inside_main", "aside"} <= used and used & {"prev_words", "next_words"}
    rows = page_text.labelled_rows()
    assert sum(page_text.decide(TREE, r[:-1]) != r[-1] for r in rows) <= len(rows) // 50


def prose(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(n))


#: Pages unlike the examples, by hand: {n} marks n words of the article, [n] others.
PAGES = [
    "<div class='content with-sidebar'><article><h1>{5}</h1><p>{33}</p><p>{2}</p></article><div class='sidebar'><p>[40]</p></div></div>",
    "<form id=aspnet><nav><a>[2]</a></nav><article><p>{61}</p></article><footer>[9]</footer></form>",
    "<div id=search-page><main><p>{12}</p><p>{70}</p><div class='advert'>[20]</div><p>{1}</p></main></div>",
    "<article><p>{44}</p></article><section id=comments><article><p>[38]</p></article><article><p>[55]</p></article></section>",
    "<div class=menu><a>[1]</a> <a>[2]</a></div><div class=post><h2>{6}</h2><p>{58}</p><p>{41}</p><p>{11}</p><p>{77}</p></div><div class=sidebar><ul><li><a>[3]</a></li><li><a>[2]</a></li></ul></div><footer>[12]</footer>",
    "<table><tr><td><a>[1]</a></td><td><a>[2]</a></td></tr><tr><td>{84}</td></tr><tr><td>{52}</td></tr></table><div>[3] <a>[4]</a></div>",
    "<div class=cookie-banner>[31]</div><h1>{7}</h1><p>{92}</p><p>{37}</p><div class=newsletter><form>[4]</form></div>",
]


def test_hand_labelled_pages():
    rng = random.Random(3)
    found = missed = extra = 0
    for page in PAGES:
        filled = re.sub(r"([{\[])(\d+)[}\]]", lambda m: " ".join(w + ("+" if m[1] == "{" else "-") for w in prose(rng, int(m[2])).split()), page)
        got = page_text.main_text(filled, TREE).split()
        want = re.findall(r"\w+\+", filled)
        found += len(want)
        missed += len(want) - sum(w.endswith("+") for w in got)
        extra += sum(w.endswith("-") for w in got)
    assert missed <= 0.02 * found and extra <= 0.02 * found


def test_pages_of_the_table_match_their_article_elements(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    block = re.compile(r"</?(?:p|h1|h2|li|ul|div|br|article)\b[^>]*>")

    def force(page):
        inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        return " ".join(html.unescape(re.sub(r"<[^>]*>", "", block.sub(" ", inside))).split())

    rows = pages.select("page_id", "html").collect()
    got = {r.page_id: r.text for r in page_text.extract(pages).collect()}
    assert len(rows) == len(got) and all(got[r.page_id] == force(r.html) for r in rows)


def test_no_markup_breaks_it():
    rng = random.Random(1)
    bits = ["<![", "[x]]>", "<![foo[bar]]>", "<!", "<!--", "-->", "<?", ">", "</", "<p", " class='", '"', "<article>", "</article>", "&", "&#x110000;", "&#0;", "&amp", "\x00", "<svg>", "]]>", "<a href=", "<script>", "</scr", "text ", "\ud83d\ude00"]
    for _ in range(5000):
        assert isinstance(page_text.main_text("".join(rng.choice(bits) for _ in range(rng.randrange(1, 16))), TREE), str)
    assert page_text.main_text("<article><p>a</p><![foo[bar]]><p>b</p></article>", TREE) == "a b"


def test_clashing_columns_nulls_and_repeated_pages(spark):
    rows = [(1, "u", "<article>x y</article>", "t", 9, "w"), (1, "u", "<article>x y</article>", "t", 9, "w"), (None, None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, words string")
    got = sorted(map(tuple, page_text.extract(pages).collect()), key=str)
    assert got == [(1, "u", "x y", 3), (1, "u", "x y", 3), (None, None, "", 0)]
    assert page_text.extract(pages.limit(0)).collect() == []
