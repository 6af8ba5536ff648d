import re

from ammolite.llm import page_text, quality_rules, secret_scan

from .helpers import SCHEMA, WORD, corpus


def rules_by_force(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_statistics_match_brute_force(spark):
    rows = [r for r in corpus(seed=4, n=40) if not r[1] or len(r[1]) < 3000]
    rows += [(900, "a b c d e\nx\n a b c d e\n\na b c d e", "", 1, ""), (901, "# | <b> & $ %% ** éé", "", 1, ""), (902, "q " * 7, "", 1, "")]
    found = quality_rules.features(spark.createDataFrame(rows, SCHEMA).select("doc_id", "text"))
    got = sorted(map(tuple, found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()))
    assert got == sorted((d, *rules_by_force(t)) for d, t, *_ in rows)


def test_decision_list_separates_what_it_was_taught(spark):
    good = [(i, " ".join(f"word{(i * 13 + k) % 97}" for k in range(60))) for i in range(300)]
    bad = [(1000 + i, " ".join(f"word{(i * 17 + k) % 89}###" for k in range(60))) for i in range(150)] + [(2000 + i, " ".join(f"WORD{(i * 7 + k) % 83}!!" for k in range(60))) for i in range(150)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(d < 1000), 0) for d, _ in good + bad if d % 3] + [(None, 1, 0), (5, None, 0), (77777, 0, 0)], "doc_id long, quality int, toxic int")
    rules = quality_rules.learn(docs, labels)
    assert 1 <= len(rules) <= quality_rules.MAX_RULES
    kept = {r.doc_id for r in quality_rules.judge(docs, rules).where("kept").collect()}
    assert kept == {d for d, _ in good}
    plan = quality_rules.judge(docs, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_no_labels_leave_the_base_rule(spark):
    docs = spark.createDataFrame([(1, None), (2, "one two three four five six seven eight nine ten")], "doc_id long, text string")
    rules = quality_rules.learn(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert rules == []
    assert sorted((r.doc_id, r.kept) for r in quality_rules.judge(docs, rules).collect()) == [(1, False), (2, True)]


def base_by_force(text):
    text = text or ""
    found = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if m[1].isascii() and len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(found)


def secrets_corpus():
    import random

    rng = random.Random(8)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    keys = lambda n: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(n))
    rows = [(i, f"héllo 🙂 token = \"{hexes(40)}\" and {keys(16)} end PASSWORD: hunter2x x", "", 1, "") for i in range(60)]
    rows += [(100, "Token=abc secret: 12345 AKIAXYZ deadbeef", "", 1, ""), (101, None, "", 1, ""), (102, "", "", 1, ""), (103, "api_key=AKIA" + "Z" * 20 + " " + "a" * 30, "", 1, ""), (104, "an ordinary internationalisation2024release of words", "", 1, "")]
    rows += [(200, f"bare {keys(16).replace('AKIA', 'AKIB')} credential", "", 1, ""), (200, "tokentoken=abcdefg", "", 1, "")]
    return rows


def test_secret_spans(spark):
    rows = secrets_corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    found = secret_scan.find_secrets(docs).collect()
    assert len(found) == len(rows)
    expected = sorted((d, [(secret_scan.KINDS[k], s, e) for s, k, e in base_by_force(t)]) for d, t, *_ in rows)
    assert sorted((r.doc_id, [tuple(x) for x in r.spans if x.kind != "format"]) for r in found) == expected
    learned = [r.doc_id for r in found for x in r.spans if x.kind == "format"]
    assert learned == [200]
    model = secret_scan.learn(secret_scan.scan(docs))
    clean = {r.text for r in secret_scan.redact(docs, model).where("doc_id = 200").collect()}
    assert clean == {"bare [SECRET] credential", "token[SECRET]"}
    assert secret_scan.find_secrets(docs.limit(0)).collect() == []


def test_merged_automaton_generalises():
    import random

    rng = random.Random(3)
    make = lambda: "sk-" + "".join(rng.choice("0123456789abcdef") for _ in range(24))
    machine = secret_scan.infer([make() for _ in range(300)])
    assert len(machine.ends) < 40
    held_out = [machine.bits(make()) for _ in range(100)]
    assert min(held_out) > machine.bits("sk-quick-brown-foxes-jump-over") + 0.5


PAGE = """<html><head><title>T</title><script>x="<p>no</p>"</script></head><body><nav><a href=/>Home</a> <a href=/b>B</a></nav><div class="cookie-notice">We use cookies on this site</div>
<article><h1>Big &amp; bold</h1><p>First <b>para</b>graph &copy; with\n  spaces.<br><p>Second one<div class="ad">Buy now, it is cheap</div><ul><li>one<li>two</ul><section id="comments"><p>Nice post!</p></section></article>
<aside>Related things</aside><form><label>Name</label></form><footer>&middot; all rights</footer></body></html>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>" + "word " * 5000 + "</p>"), (4, "u", "<nav>x</nav>"), (5, "u", "plain words without any markup at all, and quite a few of them to read")]
    got = sorted((r.page_id, r.text, r.n_chars) for r in page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    article = "Big & bold First paragraph © with spaces. Second one one two"
    long = " ".join(["word"] * 5000)
    plain = "plain words without any markup at all, and quite a few of them to read"
    assert got == sorted([(1, article, len(article)), (2, "", 0), (3, "", 0), (4, long, len(long)), (4, "", 0), (5, plain, len(plain))])
