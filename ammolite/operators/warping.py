"""Dynamic time warping: distances and paths of pairs of series over blocks of their cost matrix.

A series is rows (series, pos, v), positions from 0 without gaps. The cost matrix of a pair is cut into square blocks. Blocks on
the same anti-diagonal need only the last row of the block above, the last column of the one before and the corner between them,
so a round works on one anti-diagonal of all pairs at once, and a block is all that a task holds. Paths are walked back block by block
from what the rounds have kept of the blocks' edges.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ammolite.functions.storage import cut

BLOCK = 512


def _costs(x: np.ndarray, y: np.ndarray, top: np.ndarray, left: np.ndarray, corner: float, i0: int, j0: int, window: int | None) -> np.ndarray:
    """Least costs of a block, with the row above and the column before; what lies outside of the band is infinite."""
    p = np.full((len(x) + 1, len(y) + 1), np.inf)
    p[0, 1:], p[1:, 0], p[0, 0] = top, left, corner
    cost = np.abs(x[:, None] - y[None, :])
    if window is not None:
        far = np.abs((i0 + np.arange(len(x)))[:, None] - (j0 + np.arange(len(y)))[None, :]) > window
        cost[far] = np.inf
    for s in range(2, len(x) + len(y) + 1):
        i = np.arange(max(1, s - len(y)), min(len(x), s - 1) + 1)
        j = s - i
        p[i, j] = cost[i - 1, j - 1] + np.minimum(np.minimum(p[i - 1, j], p[i, j - 1]), p[i - 1, j - 1])
    return p


def _pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a, np.float64).tobytes()


def _unpack(b: bytes | None, n: int) -> np.ndarray:
    return np.full(n, np.inf) if b is None else np.frombuffer(b, np.float64)


def _blocks(x: DataFrame, pairs: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(pieces (series, part, v as bytes), pairs (a, b, la, lb) with the number of the last block of either)."""

    def pack(f):
        f = f.sort_values("pos")
        return pd.DataFrame({"series": f["series"].iloc[:1], "part": f["part"].iloc[:1], "v": [_pack(f["v"].to_numpy())]})

    kind = dict(x.dtypes)["series"]
    rows = x.select("series", "pos", F.floor(F.col("pos") / block).cast("int").alias("part"), F.col("v").cast("double").alias("v"))
    pieces = cut(rows.groupBy("series", "part").applyInPandas(pack, f"series {kind}, part int, v binary"), "pieces")
    last = pieces.groupBy("series").agg(F.max("part").alias("last"))
    known = pairs.select("a", "b").join(last.select(F.col("series").alias("a"), F.col("last").alias("la")), "a").join(last.select(F.col("series").alias("b"), F.col("last").alias("lb")), "b")
    return pieces, cut(known, "pairs")


def _with_pieces(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    x, y = pieces.select(F.col("series").alias("a"), F.col("part").alias("i"), F.col("v").alias("x")), pieces.select(F.col("series").alias("b"), F.col("part").alias("j"), F.col("v").alias("y"))
    return rows.join(x, ["a", "i"]).join(y, ["b", "j"])


def _rounds(pieces: DataFrame, pairs: DataFrame, window: int | None, block: int) -> tuple[DataFrame, list[DataFrame], int]:
    """(distances (a, b, distance), the edges of the blocks of each round, rounds)."""
    kinds = dict(pairs.dtypes)
    names = f"a {kinds['a']}, b {kinds['b']}, i int, j int"
    ends = pairs.agg(F.max("la").alias("i"), F.max("lb").alias("j")).first()
    rounds, edges, out = (ends.i or 0) + (ends.j or 0) + 1 if ends.i is not None else 0, [], None

    def run(frames):
        for f in frames:
            rows = []
            for a, b, i, j, la, lb, x, y, top, left, corner in f[["a", "b", "i", "j", "la", "lb", "x", "y", "top", "left", "corner"]].itertuples(index=False):
                x, y = np.frombuffer(x, np.float64), np.frombuffer(y, np.float64)
                p = _costs(x, y, _unpack(top, len(y)), _unpack(left, len(x)), 0.0 if i == j == 0 else np.inf if corner is None or np.isnan(corner) else corner, i * block, j * block, window)
                rows.append((a, b, i, j, _pack(p[-1, 1:]), _pack(p[1:, -1]), p[-1, -1], i == la and j == lb))
            yield pd.DataFrame(rows, columns=["a", "b", "i", "j", "bottom", "right", "corner", "last"])

    for r in range(rounds):
        here = pairs.withColumn("i", F.explode(F.sequence(F.greatest(F.lit(0), F.lit(r) - F.col("lb")), F.least(F.lit(r), F.col("la"))))).where(f"i <= la and {r} - i between 0 and lb").withColumn("j", (F.lit(r) - F.col("i")).cast("int"))
        if window is not None:
            here = here.where((F.abs(F.col("i") - F.col("j")) - 1) * block < window)
        here = _with_pieces(here.withColumn("i", F.col("i").cast("int")), pieces)
        key = ["a", "b", "i", "j"]
        before, earlier = (edges[r - k] if r >= k else None for k in (1, 2))
        if before is None:
            here = here.withColumns({"top": F.lit(None).cast("binary"), "left": F.lit(None).cast("binary"), "corner": F.lit(None).cast("double")})
        else:
            moved = lambda e, di, dj, *cols: e.select("a", "b", (F.col("i") + di).cast("int").alias("i"), (F.col("j") + dj).cast("int").alias("j"), *cols)
            here = here.join(moved(before, 1, 0, F.col("bottom").alias("top")), key, "left").join(moved(before, 0, 1, F.col("right").alias("left")), key, "left")
            here = here.join(moved(earlier, 1, 1, "corner"), key, "left") if earlier is not None else here.withColumn("corner", F.lit(None).cast("double"))
        done = cut(here.mapInPandas(run, f"{names}, bottom binary, right binary, corner double, last boolean"), "warp")
        edges.append(done)
        found = done.where("last").select("a", "b", F.when(F.col("corner") < float("inf"), F.col("corner")).alias("distance"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = pairs.select("a", "b", F.lit(None).cast("double").alias("distance")).limit(0)
    return out, edges, rounds


def dtw(x: DataFrame, pairs: DataFrame, window: int | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b, distance) of the pairs (a, b) of series: the least sum of absolute differences along a path from first to last values.

    A path goes on by one value of either series or of both; with `window`, places along it are at most so many apart. Where no path is that
    near, the distance is null; a series that has no rows has no distances.
    """
    pieces, known = _blocks(x, pairs, block)
    found = _rounds(pieces, known, window, block)[0]
    return known.select("a", "b").join(found, ["a", "b"], "left")


def dtw_path(x: DataFrame, pairs: DataFrame, window: int | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b, i, j): the places of both series along the best path; of equal ways back both series step first, then the first one."""
    pieces, known = _blocks(x, pairs, block)
    distances, edges, rounds = _rounds(pieces, known, window, block)
    kinds = dict(known.dtypes)
    at = known.join(distances.where("distance is not null"), ["a", "b"]).select("a", "b", F.col("la").alias("i"), F.col("lb").alias("j"), F.lit(-1).alias("r"), F.lit(-1).alias("c"))
    at = cut(at, "walk")

    def run(frames):
        for f in frames:
            rows = []
            for a, b, i, j, r, c, x_, y, top, left, corner in f[["a", "b", "i", "j", "r", "c", "x", "y", "top", "left", "corner"]].itertuples(index=False):
                x_, y = np.frombuffer(x_, np.float64), np.frombuffer(y, np.float64)
                p = _costs(x_, y, _unpack(top, len(y)), _unpack(left, len(x_)), 0.0 if i == j == 0 else np.inf if corner is None or np.isnan(corner) else corner, i * block, j * block, window)
                r, c = (len(x_) if r < 0 else r), (len(y) if c < 0 else c)
                while r > 0 and c > 0:
                    rows.append((a, b, i * block + r - 1, j * block + c - 1, 0, 0, 0, 0))
                    ways = ((p[r - 1, c - 1], r - 1, c - 1), (p[r - 1, c], r - 1, c), (p[r, c - 1], r, c - 1))
                    _, r, c = min(ways, key=lambda w: w[0])
                    if i == j == 0 and r == c == 0:
                        break
                else:
                    rows.append((a, b, -1, -1, i - (r == 0), j - (c == 0), block if r == 0 else r, block if c == 0 else c))
            yield pd.DataFrame(rows, columns=["a", "b", "i", "j", "bi", "bj", "r", "c"])

    path, key = None, ["a", "b", "i", "j"]
    every = None
    for e in edges:
        every = e if every is None else every.unionByName(e)
    for _ in range(rounds):
        moved = lambda di, dj, *cols: every.select("a", "b", (F.col("i") + di).cast("int").alias("i"), (F.col("j") + dj).cast("int").alias("j"), *cols)
        here = _with_pieces(at, pieces).join(moved(1, 0, F.col("bottom").alias("top")), key, "left").join(moved(0, 1, F.col("right").alias("left")), key, "left").join(moved(1, 1, "corner"), key, "left")
        done = cut(here.mapInPandas(run, f"a {kinds['a']}, b {kinds['b']}, i long, j long, bi int, bj int, r int, c int"), "walk")
        cells = done.where("i >= 0").select("a", "b", "i", "j")
        path = cells if path is None else path.unionByName(cells)
        at = cut(done.where("i < 0").select("a", "b", F.col("bi").alias("i"), F.col("bj").alias("j"), "r", "c"), "walk")
        if at.isEmpty():
            break
    return known.select("a", "b", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j")).limit(0) if path is None else path
