"""What several operators of this subpackage share: the shared folder, word splitting, hashing, tokenizing."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ammolite.functions.storage import shared_folder

#: Words are runs of anything but the six ASCII white space characters.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_RE = re.compile(r"[^\x20\x09-\x0D]+")
_BYTE_SPACES = bytes(range(9, 14)) + b" "


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(table: DataFrame) -> None:
    """Delete the files of a table that materialize() returned and nothing reads any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def collect_garbage(df: DataFrame) -> None:
    """Let Spark delete the shuffle files of tables that are gone: it does so when the driver's garbage is collected."""
    gc.collect()
    df.sparkSession._jvm.System.gc()


def ensure_columns(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns only, cast to the given types: other columns can't clash with those an operator adds."""
    return df.select(*(F.col(name).cast(kind).alias(name) for name, kind in kinds.items()))


class WordHash(dict):
    """64-bit hash of each distinct word (bytes), remembered up to a bound."""

    def __init__(self, most: int = 300_000, seed: int = 0):
        super().__init__()
        self.most, self.seed = most, seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word, self.seed)
        if len(word) <= 64:
            self[word] = h
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def byte_words(text: bytes) -> list[bytes]:
    """Words by ASCII white space. bytes.split() cuts at exactly the six characters of SPACE_CLASS."""
    return text.split()


#: Bits for each key in a bitmap, and its size at most (2**28 bits: 32 MB).
BITS_EACH, MOST_BITS = 16, 1 << 28


def key_bitmap(keys: DataFrame, name: str) -> np.ndarray:
    """A bitmap of bounded size with the bits set at the low bits of the hashed keys (long) in column `name`.

    It only spares work: in_bitmap() is true of every key, and of few others while the keys are many fewer than the bits.
    """
    n, bits = keys.count(), 1 << 15
    while bits < min(MOST_BITS, BITS_EACH * n):
        bits *= 2
    at = F.col(name).bitwiseAND(F.lit(bits - 1))
    rows = keys.groupBy(F.shiftright(at, 15).cast("int").alias("k")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767))).alias("b")).collect()
    out = np.zeros((bits >> 15, 4096), np.uint8)
    for k, b in rows:
        out[k] = np.frombuffer(bytes(b), np.uint8)
    return out.reshape(-1)


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * _M1
    h = h ^ (h >> np.uint64(27))
    h = h * _M2
    return h ^ (h >> np.uint64(31))


_ODD = [(2 * i + 1) * 0x9E3779B97F4A7C15 ** (i + 1) & 0xFFFFFFFFFFFFFFFF | 1 for i in range(64)]


def gram_hashes(words: np.ndarray, n: int, salt: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of every run of n (at most 64) consecutive word hashes, in order; empty if there are fewer words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = words[:m] * np.uint64(_ODD[0])
    for i in range(1, n):
        h += words[i : i + m] * np.uint64(_ODD[i])
    return mix(h ^ np.uint64(salt))


#: Bytes that are no white space, and A-Z lower-cased, as tables.
_IN_WORD = np.array([b not in _BYTE_SPACES for b in range(256)])
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
END_WORD = np.uint64(0x2545F4914F6CDD1D)


class WordBlock:
    """The words of some texts: hash (64-bit), first byte and end of each, in order, and how many each text has."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool):
        x = _LOWER[data] if lower else data
        n = len(x)
        inside = _IN_WORD[x]
        first, last = inside.copy(), np.zeros(n + 1, bool)
        if n:
            first[1:] &= ~inside[:-1]
            last[1:n] = inside[:-1] & ~inside[1:]
            last[n] = inside[-1]
            begins = bounds[:-1][(bounds[:-1] > 0) & (bounds[:-1] < n)]
            first[begins] = inside[begins]  # a word never runs on from one text into the next
            last[begins] |= inside[begins - 1]
        self.bytes, self.starts, self.ends = x, np.flatnonzero(first), np.flatnonzero(last)
        self.counts = np.diff(np.searchsorted(self.starts, bounds))
        sizes = self.ends - self.starts
        eights = np.ndarray((n + 1,), "<u8", buffer=np.concatenate([x, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
        self.hashes = mix(sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        live, at = np.arange(len(sizes)), 0
        while len(live):  # eight bytes of every word that has so many
            left = sizes[live] - at
            part = eights[self.starts[live] + at] & _MASKS[np.minimum(left, 8)]
            self.hashes[live] = mix(self.hashes[live] ^ part)
            live, at = live[left > 8], at + 8


def word_blocks(texts: pa.Array, lower: bool, most: int = 4_000_000):
    """(first text, last text + 1, WordBlock) over consecutive texts of about `most` bytes together; null texts have no words."""
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        bounds = offsets[lo : hi + 1] - offsets[lo]
        yield lo, hi, WordBlock(data[offsets[lo] : offsets[hi]], bounds, lower)
        lo = hi


def runs(lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The numbers first[k] .. first[k] + lengths[k] - 1 of all k, end to end."""
    total = int(lengths.sum())
    return np.repeat(first - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w values, by doubling."""
    m = len(x) - w + 1
    if m <= 0:
        return np.empty(0, x.dtype)
    have, out = 1, x
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[:m], out[w - have : w - have + m])


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)


#: Letters of which a run, when white space or one of the listed signs follows, is a unit for both public tokenizers.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_RUN = rf"[{_LETTERS}]+(?![^\s.,;:!?|#$%&*])"


class ChunkIds:
    """Token ids of whole texts by a `tokenizers` file, remembering those of chunks: runs of letters, the signs after them, white space.

    The pre-tokenizers of the two public files never join characters across the cuts made here, so the ids of a
    text are those of its chunks in order; texts with the control characters that the libraries classify
    differently are encoded whole. Special tokens' strings are ordinary text. Chunks not seen before are encoded
    together, as one text, and told apart by the vocabulary's own word marks.
    """

    def __init__(self, path: str, keep_space: bool, most: int = 250_000):
        # a task has one core: threads of the library's own would only hold memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.tok.no_truncation()
        self.tok.no_padding()
        # with keep_space a chunk carries the one space before it, and white space runs are chunks of their own
        self.chunk = re.compile(rf" ?{_RUN}| ?\S+|\s+(?!\S)|\s+" if keep_space else rf"{_RUN}|\S+")
        self.simple = re.compile(rf" [{_LETTERS}]+" if keep_space else rf"[{_LETTERS}]+").fullmatch
        self.odd = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x9f\ufeff]")
        self.inner = re.compile(r"(?<=\s) (?!\S)")
        self.keep_space, self.most, self.known = keep_space, most, {}
        names = map(self.tok.id_to_token, range(self.tok.get_vocab_size()))
        self.mark = np.array([x.startswith("\u0120") if keep_space else x.endswith("</w>") for x in names])

    def _encode(self, texts: list[str]) -> list[bytes]:
        got = self.tok.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() for e in got]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each of many runs of letters, from one encoding of all of them."""
        out = []
        for part in blocks(words, 20_000):
            ids = np.asarray(self.tok.encode_batch_fast([("" if self.keep_space else " ").join(part)], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(self.mark[ids])
            ends = np.append(cut[1:], len(ids)) if self.keep_space else cut + 1
            if len(ends) != len(part) or ends[-1] != len(ids):
                # a word without the mark somewhere: smaller parts leave few words beside it
                half = len(part) // 2
                out += self._encode(part) if len(part) <= 64 else self._encode_words(part[:half]) + self._encode_words(part[half:])
                continue
            raw, at = ids.tobytes(), [0, *(4 * ends).tolist()]
            out += [raw[i:j] for i, j in zip(at, at[1:])]
        return out

    def _units(self, units: list[str]) -> list[bytes]:
        """Ids of each of many short texts without odd characters."""
        cut = [u if self.simple(u) else self.chunk.findall(u) for u in units]
        every = {c for c in cut if type(c) is str}
        for c in cut:
            if type(c) is list:
                every.update(c)
        missing, ids = every.difference(self.known), self.known
        words = [w for w in missing if self.simple(w)]
        rest = [w for w in missing if not self.simple(w)] if len(words) < len(missing) else []
        ids.update(zip(words, self._encode_words(words)))
        ids.update(zip(rest, self._encode(rest)))
        out = [ids[c] if type(c) is str else b"".join([ids[x] for x in c]) for c in cut]
        # what was seen first stays: frequent chunks come early
        for c in reversed(words + rest):
            if len(ids) <= self.most:
                break
            del ids[c]
        return out

    def batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text.

        Texts are split at single spaces, each distinct piece is looked up once, and ids are gathered by the pieces' numbers.
        """
        odd = [self.odd.search(t) is not None for t in texts]
        whole = iter(self._encode([t for t, o in zip(texts, odd) if o]))
        # a space between two white spaces, or one at the end behind another, belongs to the run before it: such texts are one piece
        lone = [not o and self.keep_space and self.inner.search(t) is not None for t, o in zip(texts, odd)]
        alone = iter(self._units([t for t, x in zip(texts, lone) if x]))
        split = iter(self._gathered([t for t, o, x in zip(texts, odd, lone) if not o and not x]))
        return [next(whole if o else alone if x else split) for o, x in zip(odd, lone)]

    def _gathered(self, texts: list[str]):
        """Ids of texts that may be cut before every space."""
        pieces = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        bounds = pieces.offsets.to_numpy().astype(np.int64)
        coded = pieces.flatten().dictionary_encode()
        code, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.keep_space and len(texts):
            # the first piece of a text has no space before it
            first, at = np.unique(code[bounds[:-1]], return_inverse=True)
            code[bounds[:-1]] = at + len(names)
            names = [" " + x for x in names] + [names[k] for k in first.tolist()]
        raw = self._units(names)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        starts, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(raw), "<u4")
        del raw, names, pieces, coded
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + 500_000, "right")) - 1)
            c = code[bounds[lo] : bounds[hi]]
            ends = np.concatenate(([0], np.cumsum(sizes[c])))
            ids, cuts = flat[runs(sizes[c], starts[c])], ends[bounds[lo : hi + 1] - bounds[lo]].tolist()
            yield from (ids[i:j].tobytes() for i, j in zip(cuts, cuts[1:]))
            lo = hi


_CODERS: dict[tuple, ChunkIds] = {}


def chunk_ids(path: str, keep_space: bool) -> ChunkIds:
    """The ChunkIds of this worker process: what one task has encoded the next ones need not encode again."""
    if (path, keep_space) not in _CODERS:
        _CODERS[path, keep_space] = ChunkIds(path, keep_space)
    return _CODERS[path, keep_space]


def release() -> None:
    """Give memory that a task no longer uses back to the system: Spark's Python workers live on for other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def blocks(seq: list, size: int):
    for i in range(0, len(seq), size):
        yield seq[i : i + size]


def text_blocks(texts: list[str], most: int = 4_000_000):
    """Index ranges of consecutive texts that together hold about `most` characters, so that work on them stays small."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
