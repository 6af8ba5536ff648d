"""Small tables and brute-force versions that the tests of this folder share."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, n_words string, m long, token string"  # the last three clash with names the operators use


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=1, n=60):
    """Documents with copies, near copies, shared passages, nulls, empty and very long texts, repeats and repeated rows."""
    rng = random.Random(seed)
    shared = prose(rng, 40, 5000)
    texts = []
    for k in range(n):
        kind = k % 6
        if kind == 0 or not texts:
            texts.append(prose(rng, rng.randrange(20, 200), 3000))
        elif kind == 1:
            texts.append(rng.choice(texts))
        elif kind == 2:
            w = (rng.choice(texts) or "").split()
            for _ in range(max(1, len(w) // 40)):
                if w:
                    w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
            texts.append(" ".join(w))
        elif kind == 3:
            texts.append(prose(rng, 30, 3000) + "\n" + shared + "\t " + prose(rng, 10, 3000))
        elif kind == 4:
            texts.append(rng.choice(["", None, " \n", "one", "One two THREE", "a b c d e f g h i j k l m", "spam " * 60, "é Ü ß " * 8]))
        else:
            texts.append(prose(rng, 60, 40))
    texts += ["long " + " ".join(f"z{i % 977}" for i in range(6000)), "x" * 50_000]
    rows = [(3 * i + 5, t, "clash", 7, "clash") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def benchmark(rows):
    texts = [t for _, t, *_ in rows if t and len(t.split()) > 60]
    words = texts[0].split()
    return [(1, " ".join(words[5:35])), (2, "One two three"), (10, " ".join(texts[1].split()[:13]) + " and more words"), (11, None), (12, "!!"), (13, " ".join(words[5:35]).upper()), (14, "never seen anywhere at all")]
