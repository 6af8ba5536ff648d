import math
import random
import string
from collections import Counter

import pytest

from ammolite.llm import secret_scan


def test_formats_of_every_length_and_with_dots(spark):
    rng = random.Random(5)
    part = lambda n, letters="ABCDEFGHJKLMNPQRSTUVWXYZ23456789": "".join(rng.choice(letters) for _ in range(n))
    token = lambda: f"{part(14)}.{part(20)}.{part(14)}"
    words = ["".join(rng.choice("aeiou" if k % 2 else "bcdfghklmnprstvz") for k in range(rng.randrange(3, 15))) for _ in range(600)]
    prose = lambda: " ".join(rng.choice(words) for _ in range(12))
    rows = [(i, f"{prose()} token={token()} {prose()}") for i in range(80)]
    rows += [(i, f"{prose()} secret: {part(24)} {prose()}") for i in range(100, 180)]
    bare = {500: token(), 501: part(36), 502: part(300), 503: part(24, "ABCDEFGHJKLMNPQRSTUVWXYZ"), 504: part(15)}
    rows += [(d, f"{prose()} {v} {prose()}") for d, v in bare.items()]
    rows += [(600, f"{prose()} {part(24)}. And more {prose()}.")]
    found = {r.doc_id: [x for x in r.spans if x.kind == "format"] for r in secret_scan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    assert {d: [texts[d][x.start : x.end] for x in spans] for d, spans in found.items() if spans and d < 600} == {d: [v] for d, v in bare.items()}
    assert len(found[600]) == 1 and 24 <= found[600][0].end - found[600][0].start <= 25


def test_rare_clean_format_is_ordinary(spark):
    rng = random.Random(9)
    word = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    hexes = lambda n: word(n, "0123456789abcdef")
    rows = [(i, f"token={hexes(12)}-{hexes(10)} end") for i in range(60)]
    rows += [(1000 + i, f"part number {rng.randrange(10**11, 10**12)}-{rng.randrange(10**9, 10**10)} of it") for i in range(200)]
    rows += [(5000 + i, " ".join(f"host-{hexes(5)}.{word(9, 'abcdefghijklmnopqrstuvwxyz')}" for _ in range(40))) for i in range(1000)]
    rows += [(9000, f"bare {hexes(12)}-{hexes(10)} here")]
    found = {r.doc_id: [x for x in r.spans if x.kind == "format"] for r in secret_scan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [d for d, spans in found.items() if spans] == [9000]


def test_counts_of_ordinary_strings_cover_every_occurrence(spark):
    docs = spark.createDataFrame([(i, "aaaaaa gggggg gggggg" + " 000000" * (i % 2)) for i in range(100)], "doc_id long, text string").repartition(3)
    counts = secret_scan.ordinary(secret_scan.scan(docs), secret_scan.Formats({}))
    assert counts.strings == 350 and counts.moves[secret_scan.TREE, 0] == {"a": 100, "g": 200, "0": 50}


ALNUM = string.ascii_letters + string.digits
FORMATS = {
    "prefixed": lambda r, w: "ghp_" + w(36, ALNUM), "dashed": lambda r, w: "sk-" + w(32, ALNUM), "upper": lambda r, w: w(20, string.ascii_uppercase + string.digits),
    "base64": lambda r, w: w(44, ALNUM + "+/"), "grouped": lambda r, w: "-".join(w(n, "0123456789abcdef") for n in (8, 4, 4, 4, 12)), "short": lambda r, w: w(22, ALNUM), "dotted": lambda r, w: f"{w(12, ALNUM)}.{w(24, ALNUM)}",
}


@pytest.mark.parametrize("kind", FORMATS)
def test_recall_of_bare_credentials_however_many_the_table_holds(kind):
    rng = random.Random(5)
    word = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    make = lambda: FORMATS[kind](rng, word)
    words = [word(rng.randrange(3, 14), string.ascii_lowercase) for _ in range(4000)] + [word(rng.randrange(6, 12), string.digits) for _ in range(400)] + [word(1, string.ascii_uppercase) + word(8, string.ascii_lowercase) for _ in range(1000)]
    formats = secret_scan.Formats({"assign": [make() for _ in range(200)]})
    for bare, least_found in ((0, 90), (100, 90), (500, 85), (2000, 80)):
        planted = [make() for _ in range(100)]
        sequences = Counter()
        for value in [*(rng.choice(words) for _ in range(100_000)), *planted, *(make() for _ in range(bare))]:
            if len(value) >= formats.least:
                sequences[value.translate(secret_scan._SEQUENCE)] += 1
        moves = secret_scan.count_moves(sequences, formats.typical)
        least = max(secret_scan.SUPPORT, math.ceil(sum(sequences.values()) * secret_scan.SUPPORT_SHARE))
        model = secret_scan.Model(formats, secret_scan.Ordinary({k: n for k, n in moves.items() if n >= least or k[0] == secret_scan.SYMBOL or k[:2] == (secret_scan.TREE, 0)}, formats.typical))
        assert sum(map(model.secret, planted)) >= least_found
        assert sum(model.secret(w) for w in words if len(w) >= formats.least) <= len(words) // 500
