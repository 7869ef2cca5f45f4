"""Cross-tokenizer alignment: a dangling-suffix transducer groups the tokens of two encodings of a text.

Space and text are encoded twice, by a byte-level BPE vocabulary (A) and by a
sentence-piece model (B). The transducer reads both token sequences; its state
is the side that leads and the bytes of that side that the other has not yet
matched. The next token always comes from the other side (from A where nothing
is left over), and a step depends on the state and that token alone, so steps
are remembered. Whenever the residual is empty, a group closes.

A text is cut into units before each space that follows something other than
white space. No token of either vocabulary crosses such a place and the split
pattern never looks behind it, so units are encoded alone, once for all their
occurrences, and the residual is empty at every end of a unit.

A link is a pair of token occurrences, one of A and one of B, in the same group.
Corpus-wide, an id pair counts the documents that hold it linked. Distinct pairs
are found document by document, since a document is one row; slices of a few MB
of text sum them first, so what is shuffled is a row per slice and pair. The
counts come back to the slices by the same key, never as a broadcast.

Defined results: a null or empty text has no tokens, zeros and the empty string;
so has a text whose tokens' bytes do not join to space and text (one with U+2581
in it, say). Texts are whole, of any length. Repeated rows are documents of their
own and each counts. An empty table gives an empty table. Columns of the input
stay; those of the names that the operator adds are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritrail.llm.common import extended, prepare, slices, trim, worker_state
from veritrail.runtime import materialize

#: Bytes of text whose pairs are summed together before they are shuffled.
SLICE = 2 << 20
#: Units and bytes of units that a worker remembers; beyond either it starts anew.
CACHE_UNITS, CACHE_BYTES = 200_000, 16 << 20
#: A unit: any white space, words, and white space between them that does not begin with a space.
UNIT = r"\s*\S+(?:[^\S ]\s*\S+)*(?:[^\S ]\s*\Z)?|\s+"
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
GROUPS = "groups"
#: What a document brings to the second pass: places in its slice's table of pairs, and links of each.
PACKED = {"_slice": "long", "_links": "array<int>", "_times": "array<long>", "_pairs": "array<long>", "_docs": "array<int>"}
A, B = 0, 1
#: Bits of a token id in the key of a step.
TOKEN_BITS = 20
#: Tokens of a sequence beyond which it is stepped through alone, and links of a group beyond which its ids are counted first.
LONG, WIDE = 400, 64


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself where it prints, else the next from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def byte_level_tokens(raw: bytes) -> dict[bytes, int]:
    """Ids by token bytes of a byte-level BPE file, without its added tokens; ids follow the order of the merges."""
    spec = json.loads(raw)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    byte = byte_of_char()
    return {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}


class Transducer:
    """Groups two token sequences of the same bytes; states and steps are remembered."""

    def __init__(self, a: dict[int, bytes], b: dict[int, bytes]) -> None:
        self.tokens = (a, b)
        self.forget()

    def forget(self) -> None:
        self.state: list[tuple[int, bytes]] = [(B, b"")]  # nothing left over: A is read next
        self.reads = np.array([A], "int8")
        self.number = {(A, b""): 0, (B, b""): 0}
        self.step: dict[int, int] = {}
        self.keys, self.next = np.zeros(0, "int64"), np.zeros(0, "int64")

    def _next(self, key: int) -> int:
        """The state after the side that is behind has read a token; -1 where the bytes differ."""
        leads, residual = self.state[key >> TOKEN_BITS]
        new = self.tokens[1 - leads].get(key & (1 << TOKEN_BITS) - 1, b"")
        if new and residual.startswith(new):
            to = (leads, residual[len(new) :])
        elif new and new.startswith(residual):
            to = (1 - leads, new[len(residual) :])
        else:
            return -1
        if to not in self.number:
            self.number[to] = len(self.state)
            self.state.append(to)
        return self.number[to]

    def _one(self, key: int) -> int:
        if (to := self.step.get(key)) is None:
            to = self.step[key] = self._next(key)
        return to

    def _many(self, keys: np.ndarray) -> np.ndarray:
        """The steps of many sequences at once; those not met before are worked out and kept in order of their keys."""
        at = np.searchsorted(self.keys, keys)
        new = np.unique(keys[(at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != keys)] if len(self.keys) else keys)
        if len(new):
            all_keys = np.concatenate([self.keys, new])
            order = np.argsort(all_keys, kind="stable")
            self.next = np.concatenate([self.next, [self._one(k) for k in new.tolist()]])[order]
            self.keys = all_keys[order]
            self.reads = 1 - np.array([leads for leads, _ in self.state], "int8")
            at = np.searchsorted(self.keys, keys)
        return self.next[at]

    def run(self, tokens: tuple[np.ndarray, np.ndarray], starts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group every sequence pair of two flat token arrays (``starts`` has one place more than there are sequences).

        Returns the group of each token of A and of B within its sequence, and each sequence's number of groups, -1
        where the two do not spell the same bytes. All sequences go step by step together, long ones go alone.
        """
        n = len(starts[A]) - 1
        group = (np.zeros(len(tokens[A]), "int64"), np.zeros(len(tokens[B]), "int64"))
        at, end = [s[:-1].copy() for s in starts], [s[1:] for s in starts]
        state, closed = np.zeros(n, "int64"), np.zeros(n, "int64")
        size = (end[A] - at[A]) + (end[B] - at[B])
        for k in np.flatnonzero(size > LONG):
            closed[k] = self._alone(tokens, group, [int(s[k]) for s in at], [int(e[k]) for e in end])
        active = np.flatnonzero((size > 0) & (size <= LONG))
        while len(active):
            side = self.reads[state[active]]
            new = np.full(len(active), -1, "int64")
            for x in (A, B):
                mine = np.flatnonzero((side == x) & (at[x][active] < end[x][active]))
                who = active[mine]
                place = at[x][who]
                new[mine] = self._many(state[who] << TOKEN_BITS | tokens[x][place])
                group[x][place] = closed[who]
                at[x][who] += 1
            closed[active] += new == 0
            closed[active[new < 0]] = -1
            state[active] = new
            active = active[(new > 0) | (new == 0) & ((at[A][active] < end[A][active]) | (at[B][active] < end[B][active]))]
        return *group, closed

    def _alone(self, tokens, group, at: list[int], end: list[int]) -> int:
        closed = state = 0
        while state or at[A] < end[A] or at[B] < end[B]:
            side = 1 - self.state[state][0]
            if at[side] == end[side]:
                return -1
            group[side][at[side]] = closed
            state = self._one(state << TOKEN_BITS | int(tokens[side][at[side]]))
            at[side] += 1
            if state < 0:
                return -1
            closed += state == 0
        return closed


class Growing:
    """Arrays of numbers that grow at their end."""

    def __init__(self, kind: str) -> None:
        self.data, self.n = np.zeros(1024, kind), 0

    def extend(self, values) -> None:
        new = np.asarray(values, self.data.dtype)
        while self.n + len(new) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.n : self.n + len(new)] = new
        self.n += len(new)

    def all(self) -> np.ndarray:
        return self.data[: self.n]


def offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers one after the other, and where each list starts."""
    starts = offsets(np.fromiter(map(len, lists), "int64", len(lists)))
    return np.fromiter(chain.from_iterable(lists), "int64", int(starts[-1])), starts


def summed(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of each one's values."""
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.add.reduceat(value, first) if len(first) else value


class Aligner:
    """Both tokenizers, the transducer and the known units, in one worker process."""

    def __init__(self, raw_a: bytes, raw_b: bytes, pattern: str) -> None:
        import re

        import sentencepiece
        import tiktoken

        ranks = byte_level_tokens(raw_a)
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=raw_b)
        ids = range(self.b.get_piece_size())
        pieces = {i: self.b.id_to_piece(i) for i in ids if not self.b.is_control(i) and not self.b.is_unknown(i)}
        if any("▁" in p.lstrip("▁") for p in pieces.values()):
            raise ValueError("a piece of B has a space after other characters: units cannot be encoded alone")
        spelt = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces.items()}
        self.transducer = Transducer({i: t for t, i in ranks.items()}, spelt)
        self.unit = re.compile(UNIT)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.bytes = 0
        self.texts: list[str] = []
        self.pair_of: dict[int, int] = {}
        self.sums = {k: Growing("int64") for k in (*COUNTS, "bad", "end")}
        self.pairs, self.times = Growing("int32"), Growing("int64")
        self.transducer.forget()

    def _learn(self, units: list[str]) -> None:
        """Encode, align and remember units. Each begins with the space that B adds by itself."""
        if not units:
            return
        lists_a = [self.a.encode_ordinary(u) for u in units]
        lists_b = self.b.encode([u[1:] for u in units], num_threads=1)
        if " " in units:  # B adds no space to nothing
            lists_b[units.index(" ")] = [self.b.piece_to_id("▁")]
        tokens, starts = zip(*(flat(x) for x in (lists_a, lists_b)))
        group_a, group_b, closed = self.transducer.run(tokens, starts)
        bad = closed < 0
        first = np.concatenate([[0], np.cumsum(np.where(bad, 0, closed))])
        unit_of = [np.repeat(np.arange(len(units)), np.diff(s)) for s in starts]
        good = [~bad[u] for u in unit_of]
        group = [(first[u] + g)[ok] for u, g, ok in zip(unit_of, (group_a, group_b), good)]
        ids = [t[ok] for t, ok in zip(tokens, good)]
        sizes = [np.bincount(g, minlength=first[-1]) for g in group]

        sides = [pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets(n), pa.int32()), pa.array(t).cast(pa.string())), ",") for t, n in zip(ids, sizes)]
        spelt = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pc.binary_join_element_wise(*sides, "|"))
        self.texts += pc.binary_join(spelt, ";").to_pylist()

        pair, times, of_group = self._group_links(ids, group, sizes)
        unit = np.repeat(np.arange(len(units)), np.diff(first))[of_group]
        distinct, at = np.unique(pair, return_inverse=True)
        known = np.fromiter((self.pair_of.setdefault(k, len(self.pair_of)) for k in distinct.tolist()), "int64", len(distinct))
        key, links = summed(unit * len(self.pair_of) + known[at], times)
        unit, pair = np.divmod(key, max(1, len(self.pair_of)))
        ends = self.pairs.n + np.cumsum(np.bincount(unit, minlength=len(units)))
        self.pairs.extend(pair)
        self.times.extend(links)
        columns = [*(np.where(bad, 0, np.diff(s)) for s in starts), np.where(bad, 0, closed), np.bincount(unit, links, len(units)), bad, ends]
        for name, column in zip(self.sums, columns):
            self.sums[name].extend(column)
        self.known.update(zip(units, range(len(self.known), len(self.known) + len(units))))
        self.bytes += sum(map(len, units))

    @staticmethod
    def _group_links(ids: list[np.ndarray], group: list[np.ndarray], sizes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Id pairs (A << 32 | B), how often they are linked, and the group; a pair may come more than once for a group."""
        wide = sizes[A] * sizes[B] > WIDE
        start = offsets(sizes[B])
        narrow = ~wide[group[A]]
        of_group = group[A][narrow]
        n = sizes[B][of_group]
        at = np.repeat(start[of_group] - offsets(n)[:-1], n) + np.arange(n.sum())
        pair, times, of_group = [np.repeat(ids[A][narrow], n) << 32 | ids[B][at]], [np.ones(len(at), "int64")], [np.repeat(of_group, n)]
        start_a = offsets(sizes[A])
        for g in np.flatnonzero(wide):
            (x, m), (y, n) = (np.unique(t[s[g] : s[g + 1]], return_counts=True) for t, s in zip(ids, (start_a, start)))
            pair.append((x[:, None] << 32 | y).ravel())
            times.append((m[:, None] * n).ravel())
            of_group.append(np.full(len(x) * len(y), g))
        return np.concatenate(pair), np.concatenate(times), np.concatenate(of_group)

    def align(self, texts: list[str]) -> dict[str, pa.Array]:
        """The added columns of one slice of texts; its table of pairs stands in its first row."""
        found = [self.unit.findall(" " + t) if t else [] for t in texts]
        n = np.fromiter(map(len, found), "int64", len(found))
        coded = pa.array(chain.from_iterable(found), pa.large_string(), size=int(n.sum())).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > CACHE_UNITS or self.bytes > CACHE_BYTES:
            self.forget()
        self._learn([u for u in distinct if u not in self.known])
        unit = np.fromiter(map(self.known.__getitem__, distinct), "int64", len(distinct))[coded.indices.to_numpy()]
        doc = np.repeat(np.arange(len(texts)), n)
        sums = {k: v.all() for k, v in self.sums.items()}
        bad = np.bincount(doc, sums["bad"][unit], len(texts)) > 0
        good = ~bad[doc]
        doc, unit = doc[good], unit[good]
        ends = np.cumsum(np.bincount(doc, minlength=len(texts)))
        out = {k: pa.array(np.bincount(doc, sums[k][unit], len(texts)).astype("int64")) for k in COUNTS}
        spelt = list(map(self.texts.__getitem__, unit.tolist()))
        out[GROUPS] = pa.array([";".join(spelt[a:b]) for a, b in zip([0, *ends[:-1]], ends)], pa.string())

        key, m = np.unique(doc * len(self.known) + unit, return_counts=True)
        doc, unit = np.divmod(key, max(1, len(self.known)))
        stop = sums["end"][unit]
        size = stop - np.where(unit > 0, sums["end"][unit - 1], 0)
        at = np.repeat(stop - np.cumsum(size), size) + np.arange(size.sum())
        key, links = summed(np.repeat(doc, size) * len(self.pair_of) + self.pairs.all()[at], np.repeat(m, size) * self.times.all()[at])
        doc, pair = np.divmod(key, max(1, len(self.pair_of)))
        held, local, docs = np.unique(pair, return_inverse=True, return_counts=True)
        ids = np.fromiter(self.pair_of, "int64", len(self.pair_of))[held]
        of_doc = pa.array(offsets(np.bincount(doc, minlength=len(texts))), pa.int32())
        table = pa.array([0] + [len(ids)] * len(texts), pa.int32())
        out["_links"] = pa.ListArray.from_arrays(of_doc, pa.array(local.astype("int32")))
        out["_times"] = pa.ListArray.from_arrays(of_doc, pa.array(links))
        out["_pairs"] = pa.ListArray.from_arrays(table, pa.array(ids))
        out["_docs"] = pa.ListArray.from_arrays(table, pa.array(docs.astype("int32")))
        return out


def align_tokens(df: DataFrame, a_path: str, b_path: str, pattern: str, text: str = "text", packed: bool = False, slice_bytes: int = SLICE) -> DataFrame:
    """Add ``n_a``, ``n_b``, ``n_groups``, ``n_links`` and ``groups`` (``a1,a2|b1;a3|b2``) to every document, without a shuffle.

    ``packed`` adds what :func:`count_links` needs. The two vocabularies have fixed sizes (under 3 MB) and go out with the code.
    """
    spark = df.sparkSession
    prepare(spark)
    raw = spark.sparkContext.broadcast(tuple(open(p, "rb").read() for p in (a_path, b_path)))
    added = dict.fromkeys(COUNTS, "long") | {GROUPS: "string"} | (PACKED if packed else {})
    df = df.drop(*[c for c in added if c in df.columns])
    schema = extended(df, **added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = worker_state("align", (hash(raw.value), pattern), lambda: Aligner(*raw.value, pattern))
        task = TaskContext.get().partitionId() << 32
        for number, part in enumerate(slices(batches, text, slice_bytes)):
            found = aligner.align(part.column(text).to_pylist())
            found["_slice"] = pa.array([task | number] * len(part), pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns, *(found[c] for c in added)], names=[*part.schema.names, *added])
            del found
            trim()

    return df.mapInArrow(run, schema)


def pair_counts(tables: DataFrame) -> DataFrame:
    """``a``, ``b``, ``docs`` (documents that hold the pair linked) and ``is_best`` from rows (``pair``, ``docs``)."""
    counts = tables.groupBy("pair").agg(F.sum(F.col("docs").cast("long")).alias("docs"))
    counts = counts.select("pair", "docs", F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b"))
    best = counts.groupBy(F.col("a").alias("_a")).agg(F.max("docs").alias("_most"))
    return counts.join(best, F.col("a") == F.col("_a")).select("pair", "a", "b", "docs", (F.col("docs") == F.col("_most")).alias("is_best"))


def _slice_pairs(packed: DataFrame) -> DataFrame:
    filled = packed.filter(F.size("_pairs") > 0).select("_slice", F.arrays_zip("_pairs", "_docs").alias("_t"))
    rows = filled.select("_slice", F.posexplode("_t").alias("at", "_t"))
    # one exchange serves both the sums and the join back
    return rows.select("_slice", "at", F.col("_t._pairs").alias("pair"), F.col("_t._docs").alias("docs")).repartition("pair")


def count_links(packed: DataFrame) -> DataFrame:
    """Add ``n_best`` and ``count_sum`` to the written table of packed documents; the packed columns go.

    ``n_best`` are the links whose pair has the highest count of its A id, ``count_sum`` is the counts' sum over links.
    """
    pairs = _slice_pairs(packed)
    counts = pair_counts(pairs).select(F.col("pair").alias("_pair"), F.col("docs").alias("count"), "is_best")
    values = pairs.join(counts, F.col("pair") == F.col("_pair")).select(F.col("_slice").alias("_s"), "at", "count", "is_best")
    kept = [c for c in packed.columns if c not in PACKED]
    schema = T.StructType([*packed.select(*kept).schema.fields, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def run(docs: pa.Table, table: pa.Table) -> pa.Table:
        at = table.column("at").to_numpy()
        count, best = np.zeros(len(at), "int64"), np.zeros(len(at), "int64")
        count[at] = table.column("count").to_numpy()
        best[at] = table.column("is_best").to_numpy(zero_copy_only=False)
        links, times = (docs.column(c).combine_chunks() for c in ("_links", "_times"))
        doc = np.repeat(np.arange(len(docs)), links.value_lengths().to_numpy(zero_copy_only=False))
        where, n = links.flatten().to_numpy(), times.flatten().to_numpy()
        sums = []
        for value in (best, count):
            total = np.zeros(len(docs), "int64")
            np.add.at(total, doc, value[where] * n)
            sums.append(pa.array(total))
        return pa.Table.from_arrays([*(docs.column(c) for c in kept), *sums], schema=pa.schema([*(docs.schema.field(c) for c in kept), ("n_best", pa.int64()), ("count_sum", pa.int64())]))

    return packed.drop("_pairs", "_docs").groupBy("_slice").cogroup(values.groupBy("_s")).applyInArrow(run, schema)


def align(df: DataFrame, a_path: str, b_path: str, pattern: str, text: str = "text", keep: Callable[[DataFrame], DataFrame] = lambda aligned: aligned, slice_bytes: int = SLICE) -> DataFrame:
    """Align every document and count its links corpus-wide.

    ``keep`` is applied before the table between the two passes is written, so that a caller can drop what it does not
    need; it must leave the columns of :data:`PACKED`.
    """
    packed = align_tokens(df.drop("n_best", "count_sum"), a_path, b_path, pattern, text, True, slice_bytes)
    return count_links(materialize(keep(packed), "aligned"))
