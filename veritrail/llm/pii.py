"""Personal data by weak supervision: labelers vote on candidate spans, their reliabilities are estimated, a classifier decides.

Candidates are the base matches of four kinds (email, ip, card, phone) and looser
forms that the base patterns do not take: ``name [at] host dot org``, spaced or
full-width ``@``, defanged and version 6 addresses, card numbers with other
separators, telephone numbers without a plus sign. On each candidate six labelers
vote for, against or not at all: the base pattern, the form (checksum, ranges,
number of digits), a gazetteer (top-level domains and file endings, issuer
prefixes, calling codes, reserved networks), words before that speak for the kind,
words that speak against it, and the characters around.

Votes of all candidates of the corpus are counted per kind and pattern of votes, at
most 3^6 patterns a kind. Expectation-maximisation on these counts estimates how
often each labeler votes how on true and false spans (a labeler is never taken to
be worse than chance). The expected truth of each pattern then trains a logistic
span classifier per kind on the form and the surroundings of a span, from counts
per distinct features (at most ``FEATURE_CELLS``). A candidate that is not a base
match becomes a span where the classifier gives ``ACCEPT`` or more and it overlaps
no base match and no earlier span; base matches always stay.

Both passes read every whole text; the learning pass hands on counts only. Every
search is linear in the text: matches start at an anchor (``@``, a plus sign, the
first digit of a run) and never try a run's inner places again.

Defined results: a null text is empty and has no spans. Offsets are code points, end
exclusive. Spans come by start, then kind as listed. Rows are independent, repeated
rows give repeated results; an empty table gives an empty table, and a model learned
from one adds no spans. Columns of the input stay; one named like the added column is replaced.
"""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritrail.llm.common import extended, prepare, slices
from veritrail.runtime import discard, materialize

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
LABELERS = ("pattern", "form", "gazetteer", "context", "counter_context", "surroundings")
ACCEPT = 0.9
ROUNDS = 50
#: Sizes of the features: form, gazetteer, context (three votes each), separator, before, after, digits.
SIZES = (3, 3, 3, 5, 4, 4, 6)
FEATURE_CELLS = len(KINDS) * int(np.prod(SIZES))
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType()), T.StructField("score", T.DoubleType())]))

# Base patterns; possessive and anchored where that changes no match.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
BASE_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
BASE_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
BASE_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Looser forms. Their anchors are rare or consume what they have read.
AT = re.compile(r"@|＠|[\[({<]\x20?(?:at|@)\x20?[\])}>]|\x20at\x20", re.IGNORECASE)
LOOSE_LOCAL = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?\Z")
LOOSE_DOMAIN = re.compile(r"\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|＠|\x20?[\[({<]\x20?(?:dot|\.)\x20?[\])}>]\x20?|\x20dot\x20|\x20\.\x20)[A-Za-z0-9-]{1,63}){1,8}", re.IGNORECASE)
LOOSE_IP = re.compile(r"(?<![0-9])[0-9]{1,3}(?:\x20?[\[({]\x20?(?:\.|dot)\x20?[\])}]\x20?[0-9]{1,3}){3}(?![0-9])|(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:|::)(?:[0-9A-Fa-f]{0,4}:){1,6}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])", re.IGNORECASE)
LOOSE_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20. ‐-–/_-]{0,2}[0-9]){11,18}(?![0-9])")
LOOSE_PHONE = re.compile(r"(?<![0-9A-Za-z+])(?:00[\x20]?)?\(?[0-9]{2,5}\)?(?:[\x20./ -]{1,2}\(?[0-9]{2,5}\)?){1,5}(?![0-9A-Za-z])")

# Fixed values of the gazetteers: common top-level domains, file endings, calling codes of two and three digits by first digits,
# card issuer prefixes with their lengths, and words near personal data in English, German, French and Spanish.
DOMAINS = {"com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "eu", "de", "fr", "es", "it", "nl", "be", "at", "ch", "uk", "ie", "pt", "pl", "cz", "se", "no", "dk", "fi", "ru", "us", "ca", "mx", "br", "ar", "cl", "co", "jp", "cn", "kr", "in", "au", "nz", "za"}
ENDINGS = {"png", "jpg", "jpeg", "gif", "svg", "webp", "js", "css", "py", "txt", "html", "htm", "json", "xml", "zip", "gz", "md", "pdf"}
CALLING = {"1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "94", "98", "212", "351", "352", "353", "358", "380", "420", "421", "852", "886", "971", "972"}
ISSUERS = (("4", (13, 16, 19)), ("34", (15,)), ("37", (15,)), ("36", (14,)), ("38", (14,)), ("35", (16,)), ("51", (16,)), ("52", (16,)), ("53", (16,)), ("54", (16,)), ("55", (16,)), ("6011", (16, 19)), ("65", (16, 19)), ("62", (16, 17, 18, 19)))
FOR = (
    {"email", "e-mail", "mail", "contact", "write", "kontakt", "contacto", "correo", "courriel", "adresse"},
    {"ip", "ipv4", "ipv6", "host", "server", "address", "addr", "client", "login", "adresse", "serveur", "dirección"},
    {"card", "visa", "mastercard", "amex", "credit", "debit", "cc", "karte", "kreditkarte", "carte", "tarjeta"},
    {"phone", "tel", "telephone", "call", "fax", "mobile", "cell", "whatsapp", "telefon", "handy", "téléphone", "teléfono", "móvil", "portable"},
)
AGAINST = {"version", "v", "release", "isbn", "issn", "doi", "order", "invoice", "sku", "serial", "page", "pp", "section", "chapter", "token", "key", "hash", "commit", "build", "id", "nr", "rfc", "seite", "artikel", "bestellung", "commande", "pedido"}
WORDS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
DATE = re.compile(r"(?:[12][0-9]{3}[./\x20-][01]?[0-9][./\x20-][0-3]?[0-9]|[0-3]?[0-9][./\x20-][01]?[0-9][./\x20-][12][0-9]{3})")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(2 * int(c) - 9 * (c > "4") for c in even)) % 10 == 0


def only_digits(span: str) -> str:
    return "".join(c for c in span if "0" <= c <= "9")


def _base_emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        local = at - end - len(text[end:at].rstrip(LOCAL))
        if local and (m := DOMAIN.match(text, at + 1)):
            yield at - local, m.end()
            end = m.end()
        else:
            end = at + 1
        at = text.find("@", end)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, in order."""
    out = [(s, EMAIL, e) for s, e in _base_emails(text)]
    for m in BASE_IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append((m.start(), IP, m.end()))
    for m in BASE_CARD.finditer(text):
        if 12 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), CARD, m.end()))
    for m in BASE_PHONE.finditer(text):
        if 9 <= len(only_digits(m[0])) <= 15:
            out.append((m.start(), PHONE, m.end()))
    return sorted(out)


def _is_address(span: str) -> bool:
    try:
        ipaddress.ip_address(re.sub(r"\x20?[\[({]\x20?(?:\.|dot)\x20?[\])}]\x20?", ".", span, flags=re.IGNORECASE))
    except ValueError:
        return False
    return span not in ("::", "::1")


def loose_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the looser forms, which may overlap base matches and one another."""
    out = []
    for m in AT.finditer(text):
        local = LOOSE_LOCAL.search(text[max(0, m.start() - 65) : m.start()])
        domain = LOOSE_DOMAIN.match(text, m.end())
        if local and domain:
            out.append((m.start() - len(local[0]), EMAIL, domain.end()))
    out += [(m.start(), IP, m.end()) for m in LOOSE_IP.finditer(text) if _is_address(m[0])]
    out += [(m.start(), CARD, m.end()) for m in LOOSE_CARD.finditer(text)]
    out += [(m.start(), PHONE, m.end()) for m in LOOSE_PHONE.finditer(text) if 7 <= len(only_digits(m[0])) <= 15]
    return out


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, base) in order: base matches, and looser forms that overlap none of them."""
    base = base_spans(text)
    starts, ends, reach = [s for s, _, _ in base], [], 0
    for _, _, e in base:
        reach = max(reach, e)
        ends.append(reach)
    out = [(s, k, e, True) for s, k, e in base]
    for s, k, e in set(loose_spans(text)):
        before = bisect_left(starts, e) - 1  # the last base match that starts before the end
        if before < 0 or ends[before] <= s:
            out.append((s, k, e, False))
    return sorted(out)


def _form(kind: int, span: str, digits: str) -> int:
    """Vote of the span's own form."""
    if kind == EMAIL:
        last = re.split(r"[^A-Za-z0-9-]+", span)[-1]
        return 1 if 2 <= len(last) <= 24 and last.isalpha() and not re.search(r"\.\.|^[.-]", span) else -1
    if kind == IP and ":" in span:
        return 1 if len(re.findall("[0-9A-Fa-f]+", span)) >= 4 else -1
    if kind == IP:
        parts = re.findall("[0-9]+", span)
        return -1 if any(len(p) > 1 and p[0] == "0" for p in parts) or max(map(int, parts)) < 20 else 1
    if kind == CARD:
        return 1 if 12 <= len(digits) <= 19 and len(set(digits)) > 2 and luhn(digits) else -1
    if DATE.fullmatch(span) or len(set(digits)) < 3:
        return -1
    return 1 if 9 <= len(digits) <= 13 else -1 if len(digits) < 8 else 0


def _gazetteer(kind: int, span: str, digits: str) -> int:
    if kind == EMAIL:
        last = re.split(r"[^A-Za-z0-9-]+", span)[-1].lower()
        return 1 if last in DOMAINS else -1 if last in ENDINGS else 0
    if kind == IP:
        if ":" in span:
            return 0
        parts = [int(p) for p in re.findall("[0-9]+", span)]
        return -1 if parts[0] in (0, 127, 255) else 1
    if kind == CARD:
        return 1 if any(digits.startswith(p) and len(digits) in n for p, n in ISSUERS) else -1
    if span[0] == "+" or digits.startswith("00"):
        return 1 if any(digits.lstrip("0")[:n] in CALLING for n in (1, 2, 3)) else -1
    return 1 if span[0] in "(0" else 0


def votes(text: str, start: int, kind: int, end: int, base: bool) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Votes of the labelers (-1, 0, 1) and features of the span, each below its number in :data:`SIZES`."""
    span, digits = text[start:end], only_digits(text[start:end])
    near = [w.lower() for w in WORDS.findall(text[max(0, start - 40) : start])[-4:]]
    before, after = text[start - 1 : start], text[end : end + 1]
    context = 1 if FOR[kind].intersection(near) else 0
    counter = -1 if AGAINST.intersection(near) else 0
    inside = bool(before and (before.isalnum() or before in "=#/_-.:")) or bool(after and (after.isalnum() or after in "=/_@"))
    form, known = _form(kind, span, digits), _gazetteer(kind, span, digits)
    separators = {c for c in span if not c.isalnum()} - {"@", "+"}
    separator = 0 if not separators else 1 if separators <= {" ", "\xa0"} else 2 if separators <= {"-"} else 3 if separators <= {"."} else 4
    sides = [0 if not c or c.isspace() else 1 if c in "([{<\"'" + ")]}>,;.!?|" else 2 if c.isalnum() else 3 for c in (before, after)]
    size = 0 if not digits else min(5, 1 + len(digits) // 4)
    return (int(base), form, known, context, counter, -1 if inside else 1), (form + 1, known + 1, context + counter + 1, separator, *sides, size)


def code(values: tuple[int, ...], sizes: tuple[int, ...]) -> int:
    out = 0
    for v, n in zip(values, sizes):
        out = out * n + v
    return out


def decode(number: int, sizes: tuple[int, ...]) -> tuple[int, ...]:
    out = []
    for n in reversed(sizes):
        number, v = divmod(number, n)
        out.append(v)
    return tuple(reversed(out))


VOTE_SIZES = (3,) * len(LABELERS)


@dataclass
class Model:
    """Reliabilities of the labelers and the span classifier; a few hundred numbers."""

    #: Per kind: share of true spans, and P(vote | truth) as an array (truth, labeler, vote).
    share: dict[int, float] = field(default_factory=dict)
    reliability: dict[int, np.ndarray] = field(default_factory=dict)
    #: Per kind: bias and a weight for each value of each feature.
    weights: dict[int, np.ndarray] = field(default_factory=dict)
    _known: dict[tuple, float] = field(default_factory=dict, repr=False)

    def score(self, kind: int, features: tuple[int, ...]) -> float:
        """What the classifier gives a span; 0 for a kind of which no candidate was seen. At most ``FEATURE_CELLS`` are remembered."""
        if kind not in self.weights:
            return 0.0
        key = (kind, *features)
        if key not in self._known:
            self._known[key] = float(1 / (1 + np.exp(-_one_hot([features])[0] @ self.weights[kind])))
        return self._known[key]


def _one_hot(rows: list[tuple[int, ...]]) -> np.ndarray:
    starts = np.cumsum([1, *SIZES[:-1]])
    out = np.zeros((len(rows), 1 + sum(SIZES)))
    out[:, 0] = 1
    for i, row in enumerate(rows):
        out[i, starts + np.array(row)] = 1
    return out


def estimate(pattern: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of true spans, reliabilities and P(true | pattern) by expectation-maximisation; ``pattern`` holds 0, 1, 2 for -1, 0, 1."""
    hot = np.eye(3)[pattern]  # patterns x labelers x votes
    prior = np.array([[[0.5, 0.3, 0.2]], [[0.1, 0.3, 0.6]]]) * 4  # of false and of true spans
    truth = np.clip(0.5 + 0.2 * (pattern - 1).sum(axis=1), 0.05, 0.95)
    for _ in range(ROUNDS):
        weight = np.stack([n * (1 - truth), n * truth])
        share = (weight[1].sum() + 1) / (n.sum() + 2)
        table = np.einsum("tp,plv->tlv", weight, hot) + prior
        table /= table.sum(axis=2, keepdims=True)
        worse = (table[1, :, 2] * table[0, :, 0] < table[0, :, 2] * table[1, :, 0])  # odds of a labeler below chance
        table[:, worse] = table[:, worse].mean(axis=0)
        log = np.einsum("plv,tlv->tp", hot, np.log(table)) + np.log([[1 - share], [share]])
        truth = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
    return float(share), table, truth


def train(features: list[tuple[int, ...]], n: np.ndarray, true: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression with an L2 penalty by Newton's method; ``true`` is the expected number of true spans of ``n``."""
    x, w = _one_hot(features), np.zeros(1 + sum(SIZES))
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (true - n * p) - w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def count_votes(df: DataFrame, text: str = "text") -> DataFrame:
    """(kind, votes, features, n): how many candidates of the corpus have which votes and features."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for part in slices(batches, "text"):
            for t in part.column("text").to_pylist():
                for s, k, e, base in candidates(t or ""):
                    v, f = votes(t, s, k, e, base)
                    seen[k, code(tuple(x + 1 for x in v), VOTE_SIZES), code(f, SIZES)] += 1
        if seen:
            keys = np.array(list(seen), "int32")
            yield pa.RecordBatch.from_arrays([*map(pa.array, keys.T), pa.array(list(seen.values()), pa.int64())], names=["kind", "votes", "features", "n"])

    counts = df.select(F.col(text).alias("text")).mapInArrow(run, "kind int, votes int, features int, n long")
    return counts.groupBy("kind", "votes", "features").agg(F.sum("n").alias("n"))


def learn(df: DataFrame, text: str = "text") -> Model:
    """Reliabilities and classifier from every candidate of the corpus. The driver gets at most 3^6 rows a kind, then ``FEATURE_CELLS``."""
    counts = materialize(count_votes(df, text), "votes")
    model, rows = Model(), []
    seen = counts.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()
    for kind in sorted({r["kind"] for r in seen}):
        mine = [r for r in seen if r["kind"] == kind]
        patterns = np.array([decode(r["votes"], VOTE_SIZES) for r in mine])
        model.share[kind], model.reliability[kind], truth = estimate(patterns, np.array([r["n"] for r in mine], float))
        rows += [(kind, r["votes"], float(t)) for r, t in zip(mine, truth)]
    if rows:
        soft = df.sparkSession.createDataFrame(rows, "kind int, votes int, truth double")
        labelled = counts.join(F.broadcast(soft), ["kind", "votes"])  # at most 4 * 3^6 rows
        cells = labelled.groupBy("kind", "features").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("truth")).alias("true")).collect()
        for kind in model.share:
            mine = sorted((r for r in cells if r["kind"] == kind), key=lambda r: r["features"])
            model.weights[kind] = train([decode(r["features"], SIZES) for r in mine], np.array([r["n"] for r in mine], float), np.array([r["true"] for r in mine]))
    discard(counts)
    return model


def spans_of(text: str, model: Model, accept: float = ACCEPT) -> list[tuple[int, int, int, bool, float]]:
    """(start, kind, end, base, score): base matches, and candidates that the classifier accepts."""
    out, reach = [], 0
    for s, k, e, base in candidates(text):
        score = model.score(k, votes(text, s, k, e, base)[1])
        if base or (score >= accept and s >= reach):
            out.append((s, k, e, base, score))
            reach = reach if base else e
    return out


def find(df: DataFrame, model: Model, text: str = "text", added: str = "pii", accept: float = ACCEPT) -> DataFrame:
    """Add ``added``: an array of (kind, start, end, base, score) by start and kind."""
    prepare(df.sparkSession)
    df = df.drop(added)
    kind_type = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            found = [spans_of(t or "", model, accept) for t in part.column(text).to_pylist()]
            rows = [[{"kind": KINDS[k], "start": s, "end": e, "base": b, "score": p} for s, k, e, b, p in f] for f in found]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, pa.list_(kind_type))], names=[*part.schema.names, added])

    return df.mapInArrow(run, T.StructType([*extended(df).fields, T.StructField(added, SPANS)]))


def redact(df: DataFrame, spans: str = "pii", text: str = "text") -> DataFrame:
    """Replace each span of ``text`` by ``[KIND]``; overlapping spans become one with the kind of the first. Null texts stay null."""
    whole = F.col(text)

    def add(acc: Column, s: Column) -> Column:
        end = F.greatest(acc["end"], s["end"])
        cut = F.concat(acc["out"], whole.substr((acc["end"] + 1).cast("int"), (s["start"] - acc["end"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.when(s["start"] < acc["end"], acc["out"]).otherwise(cut).alias("out"), end.alias("end"))

    def finish(acc: Column) -> Column:
        return F.concat(acc["out"], whole.substr((acc["end"] + 1).cast("int"), F.length(whole)))

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("end"))
    return df.withColumn(text, F.when(F.size(spans) > 0, F.aggregate(F.col(spans), start, add, finish)).otherwise(whole))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
