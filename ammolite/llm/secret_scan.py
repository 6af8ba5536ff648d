"""Secret scan: fixed patterns, and formats learned from them as probabilistic automata.

The base scan finds assignments, access keys and long hex runs in the whole text. Grammar inference then learns what the
credentials of each kind look like: their strings, as sequences of character classes, form a prefix tree whose states carry
counts, and states whose outgoing and ending frequencies are statistically compatible (Hoeffding bound, recursively) are
merged, red states with blue ones, into a probabilistic automaton. All candidates of the same table, as often as they occur,
give one more to compare with: a prefix tree counted in Spark, without the branches that too few strings support; where a
string leaves it, the two symbols before decide if enough strings have them, else the frequency of the symbol. Strings that
are typical of a credential count beyond the tree only where the tree holds them whole: a clean format, or a word, has its branch
there, while random credentials soon leave it, however many of them the table holds. A string's own occurrence is taken out of the counts it is compared with. Every
other candidate string of every text is scored by its likelihood per character under each; those that a credential
automaton finds typical, and clearly likelier than the ordinary one does, are spans of kind `format`.

Candidates are the maximal runs of the characters that a labelled value can have, from the length of the shortest that can
be labelled (ASSIGN_LEAST, or a given shorter one) upwards; where a run is none itself, the run without dots around it and then its parts between dots are scored.
There is no longest candidate. A string is typical of an automaton when its bits lie within what the mean and the spread of
held-back strings give for its length (it is fitted on one half of the labelled strings and scores the other), and a secret
needs MARGIN bits a character, LEAST_BITS in all, over ordinary text.

The labelled credentials are the base spans' secrets unless the caller passes a table (kind, value). Fitting uses those of
each kind whose hashes are lowest, at most `max_labelled` and LABELLED_CHARS together; everything else covers all rows.

Defined results: a null text is empty and has no spans; very long texts and candidates are scored whole; with no labelled
credentials, or an empty table, nothing is learned and only base spans are returned; repeated rows, and rows of the same or
no doc_id, are scanned each for itself; of equal hashes the lesser string is fitted; other columns are not looked at.
Offsets are code points, end exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ammolite.llm.common import ensure_columns, materialize

KINDS = ("assign", "access", "hex", "format")
# The base patterns, and the fewest characters of what they must find.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
#: What can be a credential: runs of the characters that labelled values are made of.
RUN = r"[A-Za-z0-9+/_.=-]"
#: Strings that an automaton is fitted on, at most, and the fewest that make one.
MAX_LABELLED, LEAST_LABELLED = 2000, 12
LABELLED_CHARS = 4_000_000
ALPHA = 0.05
#: Bits a character by which a format must be likelier than ordinary text.
MARGIN = 0.75
#: Bits in all by which it must be, however short the string: about one candidate in a million by chance.
LEAST_BITS = 20.0
#: Standard deviations below its mean that a string's likelihood may lie.
SPREAD = 3.0
#: Strings that must share a branch of the ordinary tree: so many, and this share of all.
SUPPORT, SUPPORT_SHARE = 20, 1 / 20_000
#: Class sequences whose verdict is remembered.
REMEMBERED = 200_000
#: Characters of different class sequences whose moves are counted together in a task.
HELD_CHARS = 1_000_000

_CLASSES = {**dict.fromkeys("0123456789", ("0", 10)), **dict.fromkeys("abcdef", ("a", 6)), **dict.fromkeys("ghijklmnopqrstuvwxyz", ("g", 20)), **dict.fromkeys("ABCDEF", ("A", 6)), **dict.fromkeys("GHIJKLMNOPQRSTUVWXYZ", ("G", 20))}

_SIZE = dict(_CLASSES.values())
_SEQUENCE = str.maketrans({c: symbol for c, (symbol, _) in _CLASSES.items()})


def classes(value: str) -> list[str]:
    return [_CLASSES.get(c, (c, 1))[0] for c in value]


class Automaton:
    """Deterministic, with a probability for each transition and for ending in each state."""

    def __init__(self, ends: list[int], moves: list[dict[str, list[int]]]):
        self.ends, self.moves = ends, moves  # moves: symbol -> [state, count]
        self.total = [e + sum(n for _, n in m.values()) for e, m in zip(ends, moves)]

    def steps(self, value: str) -> list[float]:
        """log2 likelihood of each character and of the end; unseen moves keep a small share and return to the start."""
        state, out = 0, []
        for c in value:
            symbol, size = _CLASSES.get(c, (c, 1))
            to, n = self.moves[state].get(symbol, (0, 0))
            out.append(math.log2((n + 0.05) / (self.total[state] + 0.5)) - math.log2(size))
            state = to
        out.append(math.log2((self.ends[state] + 0.05) / (self.total[state] + 0.5)))
        return out

    def bits(self, value: str) -> float:
        """log2 likelihood a character of the string and its end."""
        return sum(self.steps(value)) / (len(value) + 1)

    def logs(self) -> None:
        """Make the logarithms of all moves once."""
        self.cost = [{s: (to, math.log2((n + 0.05) / (self.total[q] + 0.5)) - math.log2(_SIZE.get(s, 1))) for s, (to, n) in m.items()} for q, m in enumerate(self.moves)]
        self.unseen = [math.log2(0.05 / (t + 0.5)) for t in self.total]
        self.ending = [math.log2((e + 0.05) / (t + 0.5)) for e, t in zip(self.ends, self.total)]

    def at_least(self, sequence: str, least: float) -> float | None:
        """log2 likelihood of a sequence of classes and its end, or nothing as soon as it falls below `least`."""
        state, bits = 0, 0.0
        for symbol in sequence:
            move = self.cost[state].get(symbol)
            if move is None:
                bits += self.unseen[state] - math.log2(_SIZE.get(symbol, 1))
                state = 0
            else:
                state = move[0]
                bits += move[1]
            if bits < least:
                return None
        bits += self.ending[state]
        return bits if bits >= least else None


def infer(values: list[str], alpha: float = ALPHA) -> Automaton:
    """Merge compatible states of the values' prefix tree."""
    ends, moves, arrived = [0], [{}], [0]
    for value in sorted(values):
        state = 0
        arrived[0] += 1
        for symbol in classes(value):
            if symbol not in moves[state]:
                moves[state][symbol] = [len(ends), 0]
                ends.append(0)
                moves.append({})
                arrived.append(0)
            step = moves[state][symbol]
            step[1] += 1
            state = step[0]
            arrived[state] += 1
        ends[state] += 1

    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(f1, n1, f2, n2):
        return n1 and n2 and abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if differ(ends[a], arrived[a], ends[b], arrived[b]):
                return False
            for symbol in moves[a].keys() | moves[b].keys():
                x, y = moves[a].get(symbol), moves[b].get(symbol)
                if differ(x[1] if x else 0, arrived[a], y[1] if y else 0, arrived[b]):
                    return False
                if x and y:
                    todo.append((x[0], y[0]))
        return True

    def fold(a: int, b: int) -> None:
        """Add the tree below b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            ends[a] += ends[b]
            arrived[a] += arrived[b]
            for symbol, (to, n) in moves[b].items():
                if symbol in moves[a]:
                    moves[a][symbol][1] += n
                    todo.append((moves[a][symbol][0], to))
                else:
                    moves[a][symbol] = [to, n]

    red = [0]
    while True:
        blue = [(r, s) for r in red for s in sorted(moves[r]) if moves[r][s][0] not in red]
        if not blue:
            break
        r, symbol = max(blue, key=lambda x: (arrived[moves[x[0]][x[1]][0]], [-y for y in (x[0],)], x[1]))
        state = moves[r][symbol][0]
        into = next((q for q in red if compatible(q, state)), None)
        if into is None:
            red.append(state)
        else:
            moves[r][symbol][0] = into
            fold(into, state)
    at = {q: k for k, q in enumerate(red)}
    return Automaton([ends[q] for q in red], [{s: [at[to], n] for s, (to, n) in moves[q].items()} for q in red])


_ONES = (1 << 64) - 1
TREE, CONTEXT, SYMBOL = 0, 1, 2


def _child(node: int, symbol: str) -> int:
    """64-bit name of the tree node behind `node`; the root is 0."""
    node = (node + ord(symbol) + 1) * 0x9E3779B97F4A7C15 & _ONES
    return ((node ^ node >> 29) * 0xBF58476D1CE4E5B9 & _ONES) ^ node >> 32


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _context(before: str) -> int:
    """Name of the last two symbols (fewer at the start)."""
    out = 0
    for symbol in before[-2:]:
        out = out << 8 | ord(symbol)
    return out


def count_moves(sequences: dict[str, int], typical=lambda sequence: False) -> dict[tuple[int, int, str], int]:
    """(level, node, symbol or "" at the end) -> strings that make the move; for SYMBOL, how often. `typical` ones count in the tree only."""
    out: dict[tuple[int, int, str], int] = {}
    for sequence, n in sequences.items():
        node, own, alone = 0, set(), typical(sequence)
        for i, symbol in enumerate((*sequence, "")):
            out[TREE, node, symbol] = out.get((TREE, node, symbol), 0) + n
            if not alone:
                own.add((CONTEXT, _context(sequence[max(0, i - 2) : i]), symbol))
                out[SYMBOL, 0, symbol] = out.get((SYMBOL, 0, symbol), 0) + n
            if symbol:
                node = _long(_child(node & _ONES, symbol))
        for move in own:
            out[move] = out.get(move, 0) + n
    return out


class Ordinary:
    """Likelihood of ordinary strings from the supported moves of all candidates."""

    def __init__(self, moves: dict[tuple[int, int, str], int], typical=lambda sequence: False):
        """`moves` without those that too few strings support; `typical` sequences are not in the counts of contexts and symbols, and added where the tree has their end."""
        self.moves: dict[tuple[int, int], dict[str, int]] = {}
        for (level, node, symbol), n in moves.items():
            self.moves.setdefault((level, node), {})[symbol] = n
        todo, whole = [(0, "")], {}
        while todo:
            node, path = todo.pop()
            for symbol, n in self.moves.get((TREE, node), {}).items():
                if symbol:
                    todo.append((_long(_child(node & _ONES, symbol)), path + symbol))
                elif path and typical(path):
                    whole[path] = n
        for (level, node, symbol), n in count_moves(whole).items():
            if level != TREE:
                to = self.moves.setdefault((level, node), {})
                to[symbol] = to.get(symbol, 0) + n
        self.strings = sum(self.moves.get((TREE, 0), {}).values())
        self.symbols = sum(self.moves.get((SYMBOL, 0), {}).values())

    def bits(self, value: str) -> float:
        """log2 likelihood a character of the string and its end, its own occurrence left out."""
        sequence = value.translate(_SEQUENCE)
        node, arrived, out = 0, self.strings, 0.0
        own, at = self.moves.get((SYMBOL, 0), {}), {}
        for symbol in (*sequence, ""):
            at[symbol] = at.get(symbol, 0) + 1
        for i, symbol in enumerate((*sequence, "")):
            share = 1.0
            if node is not None:
                moves = self.moves.get((TREE, node), {})
                n = moves.get(symbol, 0)
                if n:
                    share = None
                    out += math.log2((n - 1 + 0.05) / (arrived - 1 + 0.5))
                    if symbol:
                        node, arrived = _long(_child(node & _ONES, symbol)), n
                else:
                    share, node = (max(0, arrived - sum(moves.values()) - 1) + 0.45) / (max(0, arrived - 1) + 0.5), None
            if share is not None:
                moves = self.moves.get((CONTEXT, _context(sequence[max(0, i - 2) : i])), {})
                n, all_ = (max(0, moves[symbol] - 1), sum(moves.values()) - 1) if symbol in moves else (max(0, own.get(symbol, 0) - at[symbol]), self.symbols - len(sequence) - 1)
                out += math.log2(share) + math.log2((n + 0.05) / (max(0, all_) + 1))
            if symbol:
                out -= math.log2(_CLASSES.get(value[i], (symbol, 1))[1])
        return out / (len(value) + 1)


def fitted(values: list[str]) -> tuple[Automaton, float, float, Automaton]:
    """An automaton of one half of the strings with what the other half, which it has not seen, has under it: mean bits a step, and how far a string's sum strays from that by the square root of its steps. Then that of all strings.

    Of the two ways round that with the likelier held-back strings.
    """
    halves, best = (values[::2], values[1::2]), None
    for own, other in (halves, halves[::-1]):
        automaton = infer(own)
        sums = [(sum(steps), len(steps)) for steps in map(automaton.steps, other)]
        mean = sum(x for x, _ in sums) / sum(n for _, n in sums)
        deviation = math.sqrt(sum((x - n * mean) ** 2 / n for x, n in sums) / len(sums))
        if best is None or mean - deviation > best[1] - best[2]:
            best = automaton, mean, deviation
    whole = infer(values)
    best[0].logs()
    whole.logs()
    return *best, whole


class Formats:
    """The automata of each kind with mean and deviation of held-back strings."""

    def __init__(self, labelled: dict[str, list[str]]):
        self.least = shortest(labelled)
        self.kinds = []
        for _, values in sorted(labelled.items()):
            if len(values) >= LEAST_LABELLED:
                self.kinds.append(fitted(values))
        self._known: dict[str, bool] = {}

    def bits(self, sequence: str) -> float | None:
        """The highest likelihood (log2) of a sequence of classes under a kind's automata, of kinds that it is typical of."""
        n, best = len(sequence) + 1, None
        for automaton, mean, deviation, whole in self.kinds:
            found = automaton.at_least(sequence, n * mean - SPREAD * deviation * math.sqrt(n))
            if found is not None:
                best = max(found, whole.at_least(sequence, -math.inf), -math.inf if best is None else best)
        return best

    def typical(self, sequence: str) -> bool:
        found = self._known.get(sequence)
        if found is None:
            n = len(sequence) + 1
            found = any(automaton.at_least(sequence, n * mean - SPREAD * deviation * math.sqrt(n)) is not None for automaton, mean, deviation, _ in self.kinds)
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            if len(sequence) <= 256:
                self._known[sequence] = found
        return found


class Model:
    """The credentials' formats, and the likelihood of ordinary strings."""

    def __init__(self, formats: Formats, ordinary: Ordinary):
        self.formats, self.least = formats, formats.least
        self.ordinary = ordinary if ordinary.strings >= LEAST_LABELLED else None
        self._known: dict[str, bool] = {}
        self._plain: set[str] = set()

    def secret(self, value: str) -> bool:
        """Depends on the classes of the characters alone, so verdicts are remembered by class sequence."""
        key = value.translate(_SEQUENCE)
        found = self._known.get(key)
        if found is None:
            found = self._judge(value)
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            if len(key) <= 256:
                self._known[key] = found
        return found

    def _judge(self, value: str) -> bool:
        n, bits = len(value) + 1, self.formats.bits(value.translate(_SEQUENCE))
        if bits is None:
            return False
        base = n * (self.ordinary.bits(value) if self.ordinary else -math.log2(64))
        return bits >= base + max(MARGIN * n, LEAST_BITS)

    def spans(self, text: str, base: list[tuple]) -> list[tuple[int, int]]:
        """(start, end) of the candidates that are secrets."""
        if not self.formats.kinds:
            return []
        if not base:  # most texts: none of their strings is a secret, as remembered
            plain = self._plain
            more = set(_runs(self.least).findall(text)).difference(plain)
            for value in more:
                if not any(self.secret(value[s:e]) for s, e in variants(value, 0, len(value), self.least)) and len(value) <= 64:
                    if len(plain) >= REMEMBERED:
                        plain.clear()
                    plain.add(value)
            if plain.issuperset(more):
                return []
        out = []
        for start, end in candidates(text, base, self.least):
            touched = [(s, e) for s, e in base if s < end and start < e]
            for s, e in variants(text, start, end, self.least):
                if not any(x < e and s < y for x, y in touched + out[-8:]) and self.secret(text[s:e]):
                    out.append((s, e))
                    if (s, e) == (start, end):
                        break
        return out


def shortest(labelled: dict[str, list[str]]) -> int:
    """The fewest characters of a candidate: those of the shortest value that can be labelled, or is."""
    return min((len(v) for values in labelled.values() if len(values) >= LEAST_LABELLED for v in values if len(v) < ASSIGN_LEAST), default=ASSIGN_LEAST)


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, kind number, end, secret) of the base scan, in the order of the contract."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end(), m[0]) for m in _long_hex(text)]
    return sorted(found)


_LONG_HEX = re.compile(r"[0-9a-f]{24,}")


def _long_hex(text: str):
    """Maximal runs of at least HEX_LEAST: the leftmost matches of [0-9a-f]+ are exactly the maximal runs."""
    return _LONG_HEX.finditer(text)


def _runs(least: int) -> re.Pattern:
    return re.compile(f"{RUN}{{{least},}}")


def candidates(text: str, base: list[tuple], least: int) -> list[tuple[int, int]]:
    """Strings that may be credentials: maximal runs of at least so many characters that no base span covers."""
    found = [m.span() for m in _runs(least).finditer(text)]
    return [(s, e) for s, e in found if not any(x <= s and e <= y for x, y in base)] if base else found


def variants(text: str, start: int, end: int, least: int):
    """Spans to score of a run: itself, without dots around it, and its parts between dots."""
    yield start, end
    run = text[start:end]
    if "." not in run:
        return
    s, e = end - len(run.lstrip(".")), start + len(run.rstrip("."))
    if e - s >= least and (s, e) != (start, end):
        yield s, e
    for m in re.finditer(f"[^.]{{{least},}}", run):
        if (start + m.start(), start + m.end()) != (s, e):
            yield start + m.start(), start + m.end()


_BASE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, text, base (spans) of every row."""

    def run(batches):
        for b in batches:
            rows = [[{"kind": k, "start": s, "end": e, "value": v} for s, k, e, v in (base_spans(t) if t else [])] for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(rows, _BASE)], names=["doc_id", "text", "base"])

    return ensure_columns(documents, doc_id="long", text="string").mapInArrow(run, "doc_id long, text string, base array<struct<kind: int, start: bigint, end: bigint, value: string>>")


def _each_text(b):
    """(text, base spans' starts and ends) of every row of a batch of scan()."""
    for text, base in zip(b.column("text").to_pylist(), b.column("base").to_pylist()):
        yield text or "", [(x["start"], x["end"]) for x in base]


def _lowest(values: DataFrame, most: int) -> list[str]:
    """Distinct values, at most `most` of them: those whose hashes are lowest, whatever the partitions."""
    few = values.select("value").distinct().select("value", F.xxhash64("value").alias("h")).orderBy("h", "value").limit(most)
    held = F.sum(F.length("value")).over(Window.orderBy("h", "value"))
    return sorted(r.value for r in few.select("value", held.alias("held")).where(F.col("held") <= LABELLED_CHARS).collect())


def ordinary(scanned: DataFrame, formats: Formats) -> Ordinary:
    """Counts of all candidates' moves; only supported ones, of which a depth has at most 1 / SUPPORT_SHARE, reach the driver."""
    least = formats.least

    def run(batches):
        def rows(sequences):
            moves = list(count_moves(sequences, formats.typical).items())
            for lo in range(0, len(moves), 50_000):
                part = moves[lo : lo + 50_000]
                yield pa.record_batch([pa.array([k[0] for k, _ in part], pa.int32()), pa.array([k[1] for k, _ in part], pa.int64()), pa.array([k[2] for k, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], names=["level", "node", "symbol", "n"])

        sequences, held = Counter(), 0
        for b in batches:
            values = Counter()
            for t, base in _each_text(b):
                values.update([t[s:e] for s, e in candidates(t, base, least)] if base else _runs(least).findall(t))
            for value, n in values.items():
                sequence = value.translate(_SEQUENCE)
                if sequence not in sequences:
                    held += len(sequence)
                sequences[sequence] += n
                if held > HELD_CHARS:
                    yield from rows(sequences)
                    sequences, held = Counter(), 0
        yield from rows(sequences)

    counts = scanned.select("text", "base").mapInArrow(run, "level int, node long, symbol string, n long").groupBy("level", "node", "symbol").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "moves")
    strings = counts.where((F.col("level") == TREE) & (F.col("node") == 0)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    first = (F.col("level") == SYMBOL) | ((F.col("level") == TREE) & (F.col("node") == 0))
    few = counts.where(first | (F.col("n") >= max(SUPPORT, math.ceil(strings * SUPPORT_SHARE))))
    return Ordinary({(r.level, r.node, r.symbol): r.n for r in few.collect()}, formats.typical)


def learn(scanned: DataFrame, labelled: DataFrame | None = None, max_labelled: int = MAX_LABELLED) -> Model:
    if labelled is None:
        labelled = materialize(scanned.select(F.explode("base").alias("x")).select(F.element_at(F.array(*map(F.lit, KINDS)), F.col("x.kind") + 1).alias("kind"), "x.value"), "labelled")
    labelled = labelled.where(F.length("value") >= 1)
    kinds = [r.kind for r in labelled.select("kind").distinct().orderBy("kind").limit(64).collect() if r.kind]
    known = {k: _lowest(labelled.where(F.col("kind") == k), max_labelled) for k in kinds}
    formats = Formats(known)
    return Model(formats, ordinary(scanned, formats))


def find_secrets(documents: DataFrame, labelled: DataFrame | None = None, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id and spans (kind, start, end), by start, of every row."""
    scanned = scan(documents)
    model = learn(scanned, labelled, max_labelled)

    def run(batches):
        for b in batches:
            out = []
            for base, (text, places) in zip(b.column("base").to_pylist(), _each_text(b)):
                spans = [(x["start"], x["kind"], x["end"]) for x in base] + [(s, 3, e) for s, e in model.spans(text, places)]
                out.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(spans)])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.record_batch([b.column("doc_id"), pa.array(out, kind)], names=["doc_id", "spans"])

    return scanned.mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: bigint, end: bigint>>")


def redact(documents: DataFrame, model: Model, mask: str = "[SECRET]") -> DataFrame:
    """`documents` with every secret's span replaced; n_chars, where there is one, follows. Other columns are kept."""

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        base = [(s, e) for s, _, e, _ in base_spans(text)]
        spans = sorted(base + model.spans(text, base))
        out, at = [], 0
        for s, e in spans:
            if s >= at:
                out += [text[at:s], mask]
            at = max(at, e)
        return "".join([*out, text[at:]]) if spans else text

    def run(batches):
        for b in batches:
            texts = [clean(t) for t in b.column("text").to_pylist()]
            columns = {n: b.column(n) for n in b.schema.names} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], b.schema.field("n_chars").type)
            yield pa.record_batch(list(columns.values()), names=list(columns))

    return documents.mapInArrow(run, documents.schema)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
    base = F.filter("spans", lambda x: x["kind"] != "format")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
