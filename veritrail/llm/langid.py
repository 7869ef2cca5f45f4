"""Language identification by unigram piece models with all segmentations summed.

Every language has one probability per piece of a fixed public vocabulary of
byte pieces (all single bytes are pieces, so every word can be segmented). A
word's probability is the sum over all its segmentations of the product of
piece probabilities, found by the forward algorithm. Training starts from piece
occurrences and runs ``ROUNDS`` of expectation maximisation (forward and
backward) over the counted words of labelled rows; the statistics of a round
have one row per language and piece, a size fixed by the vocabulary. A text is
scored by the sum over its words; the posterior of the best language is the
score.

Words are runs of letters (ASCII letters, lower-cased, and all characters beyond
ASCII) with a space before them, of any length; every piece of the vocabulary
takes part. A word of more than ``LONG_WORD`` bytes, as unspaced scripts have
them, is cut where no piece that stands in it crosses the cut: the sum of the
whole is the product of the sums of the parts, so nothing is lost. Parts that
are still longer, and words whose sum is too small for a double, are summed in
logarithms, tile by tile.

Defined results: a null text or one without a letter (Unicode category L) is
``und`` with score 0; without any labelled row all texts are ``und``; equal
posteriors take the least language name. Rows are scored one by one.

The model is fitted on about ``MAX_ROWS`` labelled rows: an equal share for each
language, those with the least hash of their id, and all rows of a language that
has fewer. The priors count all labelled rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.llm.bpe import read_ranks
from veritrail.llm.common import bucket_of_id, extended, hash_below, prepare, slices, worker_state
from veritrail.llm.toxicity import tokens
from veritrail.llm.windows import Roller
from veritrail.runtime import discard, materialize

MAX_ROWS = 100_000
ROUNDS = 2
LONG_WORD = 64
#: Bytes of a long word that are looked at in one step.
TILE = 1 << 14
#: Pseudo-count of every piece in every language.
SMOOTH = 0.1
#: Words whose probabilities a worker remembers.
CACHE_WORDS = 200_000
#: Words whose lattices are worked on at once.
BATCH_WORDS = 5_000
#: Sums below this are taken in logarithms.
TINY = 1e-250
HELD_MOD, HELD = 5, 0
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
#: Length of the beginning by which longer pieces are sought.
_HEAD = 8
_MASK = (1 << 20) - 1


class Lattice:
    """All pieces inside words, found by hashing substrings of each length."""

    def __init__(self, raw: bytes) -> None:
        pieces = sorted(read_ranks(raw))
        self.size, self.longest = len(pieces), max(map(len, pieces))
        self.lengths = sorted(set(map(len, pieces)))
        self.roller = Roller(max((LONG_WORD + 1) * BATCH_WORDS, TILE + self.longest + 1), 5)
        one = lambda b, n: int(self.roller.every(self.roller.prefix(np.frombuffer(b, "uint8")), n)[0])
        keys = np.array([one(b, len(b)) ^ len(b) for b in pieces], "uint64")
        self.head = np.zeros(_MASK + 1, bool)
        self.head[[one(b, _HEAD) & _MASK for b in pieces if len(b) > _HEAD]] = True
        # Three hash tables; a piece stands in the first whose place is free, the few left over are searched.
        self.tables, left = [], np.arange(len(keys))
        for shift in (0, 20, 40):
            slot = self._slot(keys[left], shift)
            table = np.full(_MASK + 1, -1, "int32")
            table[slot[::-1]] = left[::-1]
            self.tables.append(table)
            left = left[table[slot] != left]
        self.keys = np.append(keys, np.uint64(0))  # place -1 meets no hash
        order = np.argsort(keys[left])
        self.rest, self.rest_ids = keys[left][order], left[order].astype("int32")

    @staticmethod
    def _slot(h: np.ndarray, shift: int) -> np.ndarray:
        return ((h >> np.uint64(shift)) & np.uint64(_MASK)).astype("int64")

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each hash, or -1."""
        out = np.full(len(h), -1, "int32")
        for table, shift in zip(self.tables, (0, 20, 40)):
            found = table[self._slot(h, shift)]
            hit = (found >= 0) & (self.keys[found] == h)
            out[hit] = found[hit]
        if len(self.rest):
            k = np.minimum(np.searchsorted(self.rest, h), len(self.rest) - 1)
            hit = self.rest[k] == h
            out[hit] = self.rest_ids[k[hit]]
        return out

    def _fits(self, raw: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, ...]:
        """First byte, length and piece wherever a piece stands, in order of length; ``room``: bytes that each place may use."""
        prefix = self.roller.prefix(raw)
        most = int(room.max())
        found, at = [], np.flatnonzero(room >= 1)
        for n in self.lengths:
            if n > most:
                break
            if n > _HEAD and (not found or found[-1][1] <= _HEAD):
                at = at[room[at] > _HEAD]
                at = at[self.head[self._slot(self.roller.window(prefix, at, at + _HEAD), 0)]]
            at = at[room[at] >= n]
            p = self._find(self.roller.window(prefix, at, at + n) ^ np.uint64(n))
            hit = p >= 0
            found.append((at[hit], n, p[hit]))
        return tuple(map(np.concatenate, zip(*[(a, np.full(len(a), n), p) for a, n, p in found])))

    def edges(self, batch: list[bytes]) -> tuple[np.ndarray, ...]:
        """Word, first byte, end and piece of each place where a piece fits, in order of end and piece length; words of up to 255 bytes."""
        lengths = np.array([len(w) for w in batch])
        raw = np.frombuffer(b"".join(batch), "uint8")
        ends = np.cumsum(lengths)
        word = np.repeat(np.arange(len(batch)), lengths)
        at, n, p = self._fits(raw, ends[word] - np.arange(len(raw)))
        w = word[at]
        a = at - (ends - lengths)[w]
        order = np.argsort((a + n).astype("uint8"), kind="stable")
        w, a, n = w[order], a[order], n[order]
        return w, a, a + n, p[order], lengths

    @staticmethod
    def _runs(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
        """Stretches where neither x nor y changes; a word occurs once at most in one of equal end and start."""
        cut = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        return list(zip(cut.tolist(), [*cut[1:].tolist(), len(x)]))

    def forward(self, batch: list[bytes], probs: np.ndarray) -> np.ndarray:
        """Sums over segmentations up to each byte: words x places x languages."""
        edges = self.edges(batch)
        return self._up(edges, probs[edges[3]]).transpose(1, 0, 2)

    def _up(self, edges: tuple, given: np.ndarray) -> np.ndarray:
        """Sums up to each byte: places x words (x languages); ``given``: probability of each edge's piece."""
        w, a, b, _, lengths = edges
        out = np.zeros((int(lengths.max()) + 1, len(lengths), *given.shape[1:]))
        out[0] = 1
        for lo, hi in self._runs(a, b):
            ww = w[lo:hi]
            out[b[lo], ww] += out[a[lo], ww] * given[lo:hi]
        return out

    def _down(self, edges: tuple, given: np.ndarray) -> np.ndarray:
        """Sums from each byte to the end."""
        w, a, b, _, lengths = edges
        order = np.argsort(np.uint8(255) - a.astype("uint8"), kind="stable")
        w, a, b, given = w[order], a[order], b[order], given[order]
        out = np.zeros((int(lengths.max()) + 1, len(lengths), *given.shape[1:]))
        out[lengths, np.arange(len(lengths))] = 1
        for lo, hi in self._runs(a, b):
            ww = w[lo:hi]
            out[a[lo], ww] += out[b[lo], ww] * given[lo:hi]
        return out

    def _tile(self, word: bytes, lo: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """First byte, ends and pieces of all pieces that start in a tile of a long word."""
        part = np.frombuffer(word[lo : lo + TILE + self.longest], "uint8")
        room = np.minimum(len(part) - np.arange(len(part)), self.longest)
        room[TILE:] = 0
        at, n, p = self._fits(part, room)
        order = np.argsort(at, kind="stable")
        at, n, p = at[order], n[order], p[order]
        cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        return [(lo + int(at[i]), lo + at[i:j] + n[i:j], p[i:j]) for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(at)])]

    def parts(self, word: bytes) -> list[bytes]:
        """The word, cut wherever no piece crosses the cut if it is long."""
        if len(word) <= LONG_WORD:
            return [word]
        out, start, reach = [], 0, 0
        for lo in range(0, len(word), TILE):
            for at, ends, _ in self._tile(word, lo):
                if at and reach <= at:
                    out.append(word[start:at])
                    start = at
                reach = max(reach, int(ends[-1]))
        return [*out, word[start:]]

    def log_sum(self, word: bytes, logs: np.ndarray) -> np.ndarray:
        """ln of the sum over all segmentations of a word of any length; ``logs``: ln of the piece probabilities."""
        held = np.full((TILE + self.longest, logs.shape[1]), -np.inf)
        held[0] = 0
        for lo in range(0, len(word), TILE):
            for at, ends, p in self._tile(word, lo):
                held[ends - lo] = np.logaddexp(held[ends - lo], held[at - lo] + logs[p])
            if lo + TILE < len(word):
                held[: self.longest], held[self.longest :] = held[TILE:].copy(), -np.inf
        return held[len(word) - lo]

    def log_gains(self, word: bytes, logs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pieces and how often each is expected in a word of any length; ``logs``: ln of the probabilities in its language."""
        up, down = (np.full(len(word) + 1, -np.inf) for _ in range(2))
        up[0] = down[-1] = 0
        for lo in range(0, len(word), TILE):
            for at, ends, p in self._tile(word, lo):
                up[ends] = np.logaddexp(up[ends], up[at] + logs[p])
        for lo in range((len(word) - 1) // TILE * TILE, -1, -TILE):
            for at, ends, p in reversed(self._tile(word, lo)):
                down[at] = np.logaddexp.reduce(down[ends] + logs[p])
                yield p, np.exp(up[at] + logs[p] + down[ends] - up[-1])

    def log_sums(self, batch: list[bytes], probs: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """ln of the sums of words: words x languages."""
        out = np.empty((len(batch), probs.shape[1]))
        order = sorted(range(len(batch)), key=lambda i: len(batch[i]))
        short = [i for i in order if len(batch[i]) <= LONG_WORD]
        slow = order[len(short) :]
        for k in range(0, len(short), BATCH_WORDS):
            ids = np.array(short[k : k + BATCH_WORDS])
            part = [batch[i] for i in ids]
            sums = self.forward(part, probs)[np.arange(len(ids)), [len(w) for w in part]]
            fine = (sums > TINY).all(axis=1)
            out[ids[fine]] = np.log(sums[fine])
            slow.extend(ids[~fine].tolist())
        for i in slow:
            out[i] = self.log_sum(batch[i], logs)
        return out


def lattice(raw: bytes) -> Lattice:
    return worker_state("lattice", hash(raw), lambda: Lattice(raw))


def words(text: str | None, lat: Lattice) -> list[bytes]:
    """Words of a text with a space before each; long ones in parts."""
    found = [b" " + w for w in tokens(text)]
    if not found or max(map(len, found)) <= LONG_WORD:
        return found
    return [part for w in found for part in lat.parts(w)]


class Model:
    def __init__(self, langs: list[str], probs: np.ndarray, priors: np.ndarray) -> None:
        self.langs, self.probs, self.priors = langs, probs, priors


def learn(docs: DataFrame, vocabulary: str) -> Model | None:
    """Fit on rows of ``docs`` (doc_id, text, lang) that have a language and are not held out."""
    spark = docs.sparkSession
    prepare(spark)
    with open(vocabulary, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())
    rows = docs.select("doc_id", "text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL").filter(bucket_of_id("doc_id", HELD_MOD) != HELD)
    by_lang = dict(rows.groupBy("lang").count().collect())
    langs = sorted(by_lang)
    if not langs:
        return None
    number = {x: i for i, x in enumerate(langs)}
    if large := {x: n for x, n in by_lang.items() if n * len(langs) > MAX_ROWS}:
        share = None
        for x, n in large.items():
            share = (F if share is None else share).when(F.col("lang") == x, hash_below("doc_id", MAX_ROWS, n * len(langs)))
        rows = rows.filter(share.otherwise(True))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(raw.value)
        for part in slices(batches, "text", 2 << 20):
            counts: dict[str, Counter] = {}
            for t, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist()):
                counts.setdefault(lang, Counter()).update(words(t, lat))
            for lang, c in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])

    counted = rows.select("text", "lang").mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "lang-words")

    def expect(probs: np.ndarray | None):
        given = spark.sparkContext.broadcast(probs)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lat, probs = lattice(raw.value), given.value
            logs = None if probs is None else np.log(probs)
            sums = np.zeros((lat.size, len(langs)))
            for part in batches:
                lang = np.array([number[x] for x in part.column("lang").to_pylist()], "int64")
                n = part.column("n").to_numpy()
                batch = part.column("word").to_pylist()
                order = sorted(range(len(batch)), key=lambda i: len(batch[i]))
                short = [i for i in order if len(batch[i]) <= LONG_WORD]
                slow = order[len(short) :]
                for k in range(0, len(short), BATCH_WORDS):
                    ids = np.array(short[k : k + BATCH_WORDS])
                    edges = lat.edges([batch[i] for i in ids])
                    w, a, b, p, lengths = edges
                    own = lang[ids][w]
                    gain = n[ids][w]
                    if probs is not None:
                        q = probs[p, own]
                        up, down = lat._up(edges, q), lat._down(edges, q)
                        whole = up[lengths, np.arange(len(ids))]
                        fine = whole > TINY
                        slow.extend(ids[~fine].tolist())
                        gain = np.where(fine[w], up[a, w] * q * down[b, w] / np.where(fine, whole, 1.0)[w] * gain, 0.0)
                    np.add.at(sums, (p, own), gain)
                for i in slow:
                    if probs is None:
                        found = ((p, np.ones(len(p))) for lo in range(0, len(batch[i]), TILE) for _, _, p in lat._tile(batch[i], lo))
                    else:
                        found = lat.log_gains(batch[i], logs[:, lang[i]])
                    for p, g in found:
                        sums[p, lang[i]] += g * n[i]
            p, k = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype("int32")), pa.array(p.astype("int32")), pa.array(sums[p, k])], names=["lang", "piece", "n"])

        got = counted.mapInArrow(run, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
        out = np.full((len(read_ranks(raw.value)), len(langs)), SMOOTH)
        for r in got:
            out[r.piece, r.lang] += r.n
        return out / out.sum(axis=0)

    probs = expect(None)
    for _ in range(ROUNDS):
        probs = expect(probs)
    discard(counted)
    counts = np.array([by_lang[x] for x in langs], float)
    return Model(langs, probs, np.log(counts / counts.sum()))


def identify(df: DataFrame, model: Model | None, vocabulary: str, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add ``lang`` and ``score``; columns of these names are replaced. The model's size is set by vocabulary and languages."""
    spark = df.sparkSession
    prepare(spark)
    df = df.drop(*[c for c in (lang, score) if c in df.columns])
    schema = extended(df, **{lang: "string", score: "double"})
    with open(vocabulary, "rb") as f:
        given = spark.sparkContext.broadcast((f.read(), model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, m = given.value
        lat = lattice(raw)
        piece_logs = None if m is None else np.log(m.probs)
        known: dict[bytes, int] = {}
        logs = np.zeros((0, 0 if m is None else len(m.langs)))
        for part in slices(batches, text, 2 << 20):
            texts = part.column(text).to_pylist()
            found, sure = [UNKNOWN] * len(texts), [0.0] * len(texts)
            at = [] if m is None else [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
            if at:
                split = [words(texts[i], lat) for i in at]
                every = set().union(*split)
                if len(known) > CACHE_WORDS:
                    known, logs = {}, logs[:0]
                fresh = list(every - known.keys())
                known.update(zip(fresh, range(len(logs), len(logs) + len(fresh))))
                logs = np.concatenate([logs, lat.log_sums(fresh, m.probs, piece_logs)])
                for i, ws in zip(at, split):
                    v = logs[np.fromiter(map(known.__getitem__, ws), "int64", len(ws))].sum(axis=0) + m.priors
                    best = int(v.argmax())
                    found[i], sure[i] = m.langs[best], float(1 / np.exp(v - v[best]).sum())
                for w in fresh:
                    if len(w) > LONG_WORD:
                        del known[w]  # too long to keep
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string()), pa.array(sure, pa.float64())], names=[*part.schema.names, lang, score])

    return df.mapInArrow(run, schema)
