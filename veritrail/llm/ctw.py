"""Language-model scores by context-tree weighting over bytes.

Bytes are decomposed into eight binary choices; each choice has a tree of
contexts of up to ``DEPTH`` preceding bytes, every node a Krichevsky-Trofimov
estimate from its zeros and ones in the training texts. The weighted
probability of a node is half its own estimate plus half the product of its
children's. Frozen after training, the tree predicts a choice by mixing the
estimates along the context path with the weights that training left: w at a
node, the rest to the deeper path, and one half where no deeper node was seen.
A text's code length is the sum over its bytes and one end symbol; contexts
before the text's start are a symbol of their own.

The corpus is dealt into chunks of about ``CHUNK_BYTES`` of text. A chunk reports
its distinct byte strings of DEPTH + 1 and distinct words with training counts;
both are packed; strings are dealt by the two most recent context bytes, words by
their hash, to tasks that sum their counts, build their trees and send each
chunk the values of its own keys. So nothing that grows with the corpus is
broadcast or collected: the driver sees at most 256 * 255 statistics of contexts
of one byte.

The unigram baseline follows the same way: tokens are white-space words in
ASCII lower case and one end token a text, add-one smoothed. Keys of words are
64-bit hashes; two of n distinct words share one with probability n**2 / 2**65.
Defined results: a null text is empty, an empty text has the end token and end
symbol only; without training rows all counts are 0 and every choice is even.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import bucket_of_id, prepare, release, stable_rows
from veritrail.runtime import materialize

DEPTH = 6  # a byte string and the mark of its kind have room in 64 bits up to this depth
CHUNK_BYTES = 24 << 20
#: Reported byte strings of one training task, on average.
TASK_KEYS = 400_000
#: Text per part of the hashes of words, about; a power of two parts.
WORD_PART_BYTES = 8 << 20
HELD_MOD, HELD = 7, 2
#: Symbols that no UTF-8 text has: before the start, and the end.
START, END = 0xFE, 0xFF
#: Key of the end token; word keys are odd, byte strings are even.
END_TOKEN = -1

U = np.uint64
_TILE = 2 << 20
#: The bits of a key below its two most recent context bytes.
_BELOW_PAIR = 8 * (DEPTH - 1) + 1
_CODEC = pa.Codec("zstd", 1)
#: Lowest bytes of the values of byte strings that are not sent.
DROPPED = 2


def _pack(x: np.ndarray, drop: int = 0) -> bytes:
    """Eight-byte numbers as compressed bytes, all first bytes before all second ones; the ``drop`` lowest bytes are rounded away."""
    if drop:
        x = np.ascontiguousarray(x).view(U) + (U(1) << U(8 * drop - 1))
    return _CODEC.compress(np.ascontiguousarray(x).view("uint8").reshape(-1, 8)[:, drop:].T.tobytes(), asbytes=True)


def _unpack(raw: bytes, n: int, kind: str, drop: int = 0) -> np.ndarray:
    out = np.zeros((n, 8), "uint8")
    out[:, drop:] = np.frombuffer(_CODEC.decompress(raw, (8 - drop) * n, asbytes=True), "uint8").reshape(8 - drop, n).T
    return out.view(kind).ravel()


def _pack_keys(sorted_keys: np.ndarray) -> bytes:
    return _pack(np.diff(sorted_keys, prepend=U(0)))


def _unpack_keys(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpack(raw, n, "uint64"), dtype=U)


def _word_key(w: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little", signed=True) | 1


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _gram_keys(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of the byte strings of a few texts, with the number of the text; bounded pieces."""
    held: list[bytes] = []
    sizes: list[int] = []

    def keys(parts: list[bytes], who: list[int]):
        wide = np.frombuffer(b"".join(parts), "uint8").astype(U)
        key = wide[DEPTH:].copy()
        for j in range(1, DEPTH + 1):  # the most recent byte of the context is the highest
            key |= wide[DEPTH - j : -j] << U(8 * (DEPTH + 1 - j))
        inside = np.ones(len(key), bool)  # a string must not reach over the end of a piece
        ends = np.cumsum([len(p) for p in parts[:-1]], dtype="int64")
        inside[(ends[:, None] - 1 - np.arange(DEPTH)).ravel()] = False
        return key[inside] << U(1), np.repeat(who, [len(p) - DEPTH for p in parts])

    for i, t in enumerate(texts):
        raw = bytes([START]) * DEPTH + (t or "").encode() + bytes([END])
        for lo in range(0, len(raw) - DEPTH, _TILE):
            held.append(raw[lo : lo + _TILE + DEPTH])
            sizes.append(i)
            if sum(map(len, held[-64:])) >= _TILE or len(held) >= 2000:
                yield keys(held, sizes)
                held, sizes = [], []
    if held:
        yield keys(held, sizes)


def _report(batches: Iterator[pa.RecordBatch], word_parts: int) -> Iterator[pa.RecordBatch]:
    """Distinct keys of each chunk with their training counts: a row for all byte strings of one pair of most recent bytes, and for all words of one part of the hashes (numbered from -1 down)."""
    words: dict[int, tuple[Counter, set]] = {}
    grams: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        by: dict[tuple[int, bool], list] = {}
        for c, h, t in zip(batch.column("chunk").to_pylist(), batch.column("held").to_pylist(), batch.column("text").to_pylist()):
            by.setdefault((c, h), []).append(t)
        for (c, h), texts in by.items():
            counts, others = words.setdefault(c, (Counter(), set()))
            for t in texts:
                if h:
                    others.update(_words(t))
                else:
                    counts.update(_words(t))
                    counts[None] += 1
            for key, _ in _gram_keys(texts):
                u, n = np.unique(key, return_counts=True)
                held = grams.setdefault(c, [])
                held.append((u, np.zeros_like(n) if h else n))
                while len(held) > 1 and len(held[-2][0]) < 2 * len(held[-1][0]):  # so few pieces of falling size are kept
                    held.append(_merged(held.pop(), held.pop()))
    for c, (counts, others) in words.items():
        held = grams.pop(c)
        while len(held) > 1:
            held.append(_merged(held.pop(), held.pop()))
        u, n = held.pop()
        keys = [END_TOKEN if w is None else _word_key(w) for w in counts] + [_word_key(w) for w in others - counts.keys()]
        k, v = np.array(keys, "int64").view(U), np.array(list(counts.values()) + [0] * (len(keys) - len(counts)), "int64")
        order = np.argsort(k)
        k, v = k[order], v[order]
        yield from _rows(c, -1 - (k >> U(1) & U(word_parts - 1)).astype("int64"), k, v)
        yield from _rows(c, (u >> U(_BELOW_PAIR)).astype("int64"), u, n)


def _rows(chunk: int, part: np.ndarray, key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted keys of a chunk with their counts, packed into a row for each part."""
    order = np.argsort(part, kind="stable")
    part, key, n = part[order], key[order], n[order]
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    ends = np.r_[starts[1:], len(part)]
    for lo in range(0, len(starts), 2000):
        spans = list(zip(starts[lo : lo + 2000].tolist(), ends[lo : lo + 2000].tolist()))
        arrays = [
            pa.array([chunk] * len(spans), pa.int32()), pa.array(part[starts[lo : lo + 2000]]), pa.array([e - b for b, e in spans], pa.int64()),
            pa.array([_pack_keys(key[b:e]) for b, e in spans], pa.binary()), pa.array([_pack(n[b:e]) for b, e in spans], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(arrays, names=["chunk", "part", "n", "keys", "counts"])


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of two sorted pieces, each once, with the sum of its counts."""
    key, n = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[starts], np.add.reduceat(n[order], starts)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for x >= 1/2, by Stirling's series after a shift of 8."""
    shift = np.ones_like(x)
    for j in range(8):
        shift *= x + j
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


#: ln gamma of 1/2, 3/2, ... and of 1, 2, ... for counts below 2**16, which nearly all nodes have.
_OF_HALF, _OF_ONE = (_lgamma(np.arange(1 << 16) + x) for x in (0.5, 1.0))


def _ln_gamma(x: np.ndarray, shift: float, table: np.ndarray) -> np.ndarray:
    """ln gamma(x + shift) for whole x."""
    x = np.asarray(x)
    out = table[np.minimum(x, len(table) - 1).astype("int64")]
    large = x >= len(table)
    if large.any():
        out[large] = _lgamma(x[large] + shift)
    return out


def kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _ln_gamma(a, 0.5, _OF_HALF) + _ln_gamma(b, 0.5, _OF_HALF) - _ln_gamma(a + b, 1.0, _OF_ONE) - math.log(math.pi)


def _mix(zero: np.ndarray, one: np.ndarray, below: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Weight and estimate of nodes, and ln of their weighted probability, from that of their children; nodes never seen have 0."""
    own = kt(zero, one)
    weighted = np.logaddexp(own, below) - math.log(2)
    return (np.exp(own - weighted - math.log(2)), (one + 0.5) / (zero + one + 1)), weighted


class Trees:
    """The context trees below some pairs of most recent bytes, from sorted distinct byte strings and their counts.

    A string is its context, the most recent byte highest, and the symbol. In order of strings of a depth, the nodes of
    every binary choice are runs of strings that agree in the context and the bits of the symbol before the choice, so
    each depth is sorted once and the eight choices need no sort of their own.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray) -> None:
        strings, counts = keys >> U(1), n.astype(float)  # the mark of the kind goes
        #: Of each depth from the deepest: strings, counts, and the place of each string among those of the depth above.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray | None]] = []
        for _ in range(DEPTH - 2):
            shorter = strings >> U(16) << U(8) | (strings & U(0xFF))  # without the oldest byte
            above, place = np.unique(shorter, return_inverse=True)
            self.levels.append((strings, counts, place))
            strings, counts = above, np.bincount(place, weights=counts, minlength=len(above))
        self.levels.append((strings, counts, None))

    def _climb(self, i: int):
        """Of choice ``i`` and each depth from the deepest: node of each string, first string, zeros, ones, weight and estimate, ln weighted probability."""
        weighted = starts = place = None
        for strings, counts, up in self.levels:
            run = strings >> U(8 - i)
            new = np.r_[True, run[1:] != run[:-1]] if len(run) else np.zeros(0, bool)
            at, first = np.cumsum(new) - 1, np.flatnonzero(new)
            one = counts * ((strings >> U(7 - i)) & U(1))
            total, one = (np.add.reduceat(x, first) if len(first) else x for x in (counts, one))
            zero = total - one
            if weighted is None:
                given, weighted = (None, (one + 0.5) / (total + 1)), kt(zero, one)
            else:
                given, weighted = _mix(zero, one, np.bincount(at[place[starts]], weights=weighted, minlength=len(first)))
            yield at, first, zero, one, given, weighted
            starts, place = first, up

    def tops(self) -> tuple[np.ndarray, ...]:
        """Choice (most recent byte and bits before it), zeros, ones and ln weighted probability of the nodes of two bytes of context."""
        out = []
        strings = self.levels[-1][0]
        for i in range(8):
            for _, first, zero, one, _, weighted in self._climb(i):
                pass
            out.append((self._choice(strings[first], i), zero, one, weighted))
        return tuple(map(np.concatenate, zip(*out)))

    @staticmethod
    def _choice(strings: np.ndarray, i: int) -> np.ndarray:
        """Most recent byte and choice of strings with two bytes of context."""
        return ((strings >> U(16)) << U(8) | U(1) << U(i) | (strings & U(0xFF)) >> U(8 - i)).astype("int64")

    def log_probabilities(self, root: tuple[np.ndarray, np.ndarray], first: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """log10 probability of the last byte of each string; root, first: weight and estimate of each binary choice, without context and by the most recent byte."""
        strings = self.levels[0][0]
        out = np.zeros(len(strings))
        for i in range(8):
            q = where = None
            for (texts, _, up), (at, _, _, _, (w, estimate), _) in zip(self.levels, self._climb(i)):
                if q is None:
                    q, where = estimate[at], np.arange(len(strings))
                else:
                    node = at[where]
                    q = w[node] * estimate[node] + (1 - w[node]) * q
                where = where if up is None else up[where]
            z = self._choice(texts, i)[where]
            q = first[0][z] * first[1][z] + (1 - first[0][z]) * q
            z &= 0xFF
            q = root[0][z] * root[1][z] + (1 - root[0][z]) * q
            out += np.log10(np.where(((strings >> U(7 - i)) & U(1)).astype(bool), q, 1 - q))
        return out


def _collected(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, bytes]], np.ndarray] | None:
    """Distinct keys of one task and their counts, its rows (chunk, part, number of keys, packed keys), and the place of each row's keys among the distinct ones."""
    rows, keys, counts = [], [], []
    for b in batches:
        for chunk, part, n, k, c in zip(*(b.column(x).to_pylist() for x in ("chunk", "part", "n", "keys", "counts"))):
            rows.append((chunk, part, n, k))
            keys.append(_unpack_keys(k, n))
            counts.append(_unpack(c, n, "int64"))
    if not rows:
        return None
    key, n = np.concatenate(keys), np.concatenate(counts)
    del keys, counts
    order = np.argsort(key)
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]]
    place = np.empty(len(key), "int32")
    place[order] = np.cumsum(new) - 1
    return key[new], np.bincount(place, weights=n), rows, place


def _answers(rows: list[tuple[int, int, int, bytes]], logs: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of one task with the values of their keys; those of byte strings (parts from 0) to some eleven digits, which is less to move."""
    at = 0
    for lo in range(0, len(rows), 2000):
        part, packed = rows[lo : lo + 2000], []
        for _, number, n, _ in part:
            packed.append(_pack(logs[place[at : at + n]], DROPPED if number >= 0 else 0))
            at += n
        columns = list(zip(*part))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns, kinds), pa.array(packed, pa.binary())], names=["chunk", "part", "n", "keys", "logs"])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = _collected(batches)
    if found is not None:
        yield pa.RecordBatch.from_arrays([pa.array([int(found[1].sum())]), pa.array([int((found[1] > 0).sum())])], names=["tokens", "known"])


def _word_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = _collected(batches)
    if found is not None:
        yield from _answers(found[2], np.log10(found[1] + 1), found[3])


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = _collected(batches)
    if found is not None:
        choice, zero, one, weighted = Trees(*found[:2]).tops()
        z, at = np.unique(choice, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(z.astype("int32")), *[pa.array(np.bincount(at, weights=x, minlength=len(z))) for x in (zero, one, weighted)]], names=["z", "zero", "one", "weighted"])


def score(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and scores of each row: the columns of ``df`` but the text, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte."""
    spark = df.sparkSession
    prepare(spark)
    added = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")
    names = [c for c in df.columns if c != text and c not in added]
    keep = [f"_k{i}" for i in range(len(names))]  # no column of the caller's meets one of ours
    df = stable_rows(df).withColumn("_held", bucket_of_id(doc_id, HELD_MOD) == HELD).select(*[F.col(c).alias(k) for c, k in zip(names, keep)], F.col(text).alias("text"), "_held", "_rid")
    total = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_chunks = max(1, -(-total // CHUNK_BYTES))
    docs = df.select(*keep, "text", F.col("_held").alias("held"), F.pmod(F.xxhash64("_rid"), F.lit(n_chunks)).cast("int").alias("chunk"))
    word_parts = 1 << max(0, (total // WORD_PART_BYTES).bit_length())
    # Word keys as unsigned numbers; the end token's is the greatest.
    seen = materialize(docs.select("chunk", "held", "text").repartitionById(n_chunks, "chunk").mapInArrow(lambda b: _report(b, word_parts), "chunk int, part long, n long, keys binary, counts binary"), "chunk-keys")
    release(spark)
    words = seen.filter("part < 0").repartition(word_parts, "part")
    train_tokens, vocabulary = words.mapInArrow(_totals, "tokens long, known long").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    strings = seen.filter("part >= 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    grams = seen.filter("part >= 0").repartition(max(1, -(-strings // TASK_KEYS)), "part")
    below = np.zeros((3, 1 << 16))  # zeros, ones and weighted probability below each choice after each byte
    for r in grams.mapInArrow(_roots, "z int, zero double, one double, weighted double").groupBy("z").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one"), F.sum("weighted").alias("weighted")).collect():
        below[:, r.z] = r.zero, r.one, r.weighted
    first, weighted = _mix(*below)
    root, _ = _mix(*(x.reshape(256, 256).sum(axis=0) for x in (below[0], below[1], weighted)))

    release(spark)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _collected(batches)
        if found is not None:
            yield from _answers(found[2], Trees(*found[:2]).log_probabilities(root, first), found[3])

    schema = "chunk int, part long, n long, keys binary, logs binary"
    # Not written: the shuffle to the chunks holds them already, and what an executor loses comes again from the reported keys.
    answers = grams.mapInArrow(values, schema).unionByName(words.mapInArrow(_word_values, schema))
    denominator = math.log10(train_tokens + vocabulary + 1)
    kinds = [("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64()), ("bits_per_byte", pa.float64())]

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        def known(rows: pa.Table, drop: int) -> tuple[np.ndarray, np.ndarray]:
            """Keys and values of some parts, one part after the other."""
            sizes = rows.column("n").to_numpy()
            ends = np.cumsum(sizes)
            key, logs = np.empty(int(sizes.sum()), U), np.empty(int(sizes.sum()))
            for n, end, k, x in zip(sizes.tolist(), ends.tolist(), rows.column("keys"), rows.column("logs")):
                key[end - n : end] = _unpack_keys(k.as_py(), n)
                logs[end - n : end] = _unpack(x.as_py(), n, "float64", drop)
            return key, logs

        right = right.sort_by("part")
        key, logs = known(right.filter(pc.less(right.column("part"), 0)), 0)
        value = dict(zip(key.view("int64").tolist(), logs.tolist()))
        gram, logs = known(right.filter(pc.greater_equal(right.column("part"), 0)), DROPPED)  # parts are ranges of keys
        del right, key
        of_word: dict[bytes, float] = {}
        end = value.get(END_TOKEN, 0.0)
        out = {k: [] for k, _ in kinds}
        texts = left.column("text").to_pylist()
        for lo in range(0, len(texts), 256):
            part = texts[lo : lo + 256]
            sums = np.zeros(len(part))
            for k, who in _gram_keys(part):
                order = np.argsort(k)  # neighbours are looked up one after the other
                sums += np.bincount(who[order], weights=logs[np.searchsorted(gram, k[order])], minlength=len(part))
            for t, s in zip(part, sums.tolist()):
                ws = _words(t)
                for w in {w for w in ws if w not in of_word}:
                    of_word[w] = value[_word_key(w)]
                v = list(map(of_word.__getitem__, ws))
                v.append(end)
                size = len((t or "").encode())
                row = (len(v), len(v) - v.count(0.0), train_tokens, math.fsum(v) - len(v) * denominator, s, size, -s / math.log10(2) / (size + 1))
                for name, x in zip(out, row):
                    out[name].append(x)
        table = left.select([*keep, "held"]).rename_columns([*keep, "held_out"])
        for name, kind in kinds:
            table = table.append_column(name, pa.array(out[name], kind))
        return table

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    schema = f"{fields}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    out = docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(apply, schema)
    return out.withColumnsRenamed(dict(zip(keep, names)))
