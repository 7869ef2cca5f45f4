"""Evaluators and signers from outside: Python objects that run next to the data, in Arrow batches.

A factory goes to the workers and makes its object there, once a process; sockets,
clients and private keys are opened where they are used and never travel. What an
evaluator cannot decide is denied: an error in set-up, in a decision, or an answer
that is none, with the kind of the error beside it. A signer that cannot sign ends
the job, as a receipt must not go out unsigned; one that cannot verify says invalid.
"""

from __future__ import annotations

import hmac
import json
import uuid
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol, runtime_checkable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from veritrail.functions.canon import canonical_json
from veritrail.operators.receipts import payload
from veritrail.runtime import ship

#: The rule that stands for a decision which an evaluator could not make.
FAILED = "evaluator_failed"
DECIDED = {"decision": T.StringType(), "rules_fired": T.ArrayType(T.StringType()), "decision_error": T.StringType()}


@runtime_checkable
class Evaluator(Protocol):
    """A policy backend. Decisions depend on the inputs alone and have no side effects, as tasks may run again."""

    evaluator_name: str
    policy_id: str
    policy_version_hash: str

    def evaluate(self, inputs: Sequence[dict]) -> Sequence[tuple[str, Sequence[str]]]:
        """Decision (``allow`` or ``deny``) and names of the rules that fired, for each row of inputs."""
        ...


_made: dict[str, object] = {}


def _once(key: str, factory: Callable[[], object]):
    """What the factory makes in this process; an error is not kept, so the next batch tries again."""
    if key not in _made:
        _made[key] = factory()
    return _made[key]


def _answer(found) -> tuple[str, list[str], str | None]:
    decision, rules = found
    if decision not in ("allow", "deny") or isinstance(rules, str):
        raise ValueError("no decision")
    return decision, [str(r) for r in rules], None


def _decide(evaluator: Evaluator, rows: list[dict]) -> list[tuple[str, list[str], str | None]]:
    """Answers for a batch; where it fails as a whole, its rows are asked one by one, and those that fail are denied."""
    try:
        found = list(evaluator.evaluate(rows))
        if len(found) != len(rows):
            raise ValueError("not an answer a row")
        return [_answer(x) for x in found]
    except Exception as e:  # noqa: BLE001
        if len(rows) == 1:
            return [("deny", [FAILED], type(e).__name__)]
    return [x for r in rows for x in _decide(evaluator, [r])]


def evaluate(df: DataFrame, factory: Callable[[], Evaluator], inputs: dict[str, Column]) -> DataFrame:
    """Add ``decision``, ``rules_fired`` and ``decision_error`` from an evaluator that sees the ``inputs`` by name.

    Inputs are Columns of any type; they reach the evaluator as Python values. Columns of ``df`` with the names of the
    added ones are replaced.
    """
    ship(df.sparkSession)
    kept = [c for c in df.columns if c not in DECIDED]
    names = {n: f"_in{i}" for i, n in enumerate(inputs)}
    rows = df.withColumns({names[n]: c for n, c in inputs.items()}).select(*kept, *names.values())
    schema = T.StructType([*df.select(*kept).schema.fields, *[T.StructField(n, t) for n, t in DECIDED.items()]])
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [dict(zip(names, row)) for row in zip(*(batch.column(c).to_pylist() for c in names.values()))] if names else [{}] * len(batch)
            try:
                found = _decide(_once(key, factory), values) if values else []
            except Exception as e:  # noqa: BLE001
                found = [("deny", [FAILED], type(e).__name__)] * len(values)
            columns = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.list_(pa.string())), pa.array([x[2] for x in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], names=[*kept, *DECIDED])

    return rows.mapInArrow(run, schema)


class Signer(ABC):
    """A signature scheme; ``algorithm`` is recorded in the receipt."""

    algorithm: str

    @abstractmethod
    def sign(self, message: bytes) -> str:
        """Signature of a message, as text."""

    def verify(self, message: bytes, signature: str) -> bool:
        """Whether a signature fits; schemes with a public key must say it themselves."""
        return hmac.compare_digest(self.sign(message), signature)


def sign_receipts(receipt_json: Column, factory: Callable[[], Signer]) -> Column:
    """The receipt with its signature block, as canonical JSON; null stays null."""
    key = uuid.uuid4().hex

    @pandas_udf(T.StringType())
    def sign(s):
        signer = _once(key, factory)

        def one(text: str) -> str:
            value = json.loads(text)
            value["signature"] = {"algorithm": signer.algorithm, "value": signer.sign(payload(text))}
            return canonical_json(value)

        return s.map(one, na_action="ignore")

    return sign(receipt_json)


def signature_state(receipt_json: Column, factories: Sequence[Callable[[], Signer]]) -> Column:
    """valid, invalid, unsigned or malformed, by the signer whose algorithm the receipt names; an unknown one is invalid."""
    key = uuid.uuid4().hex

    @pandas_udf(T.StringType())
    def check(s):
        signers = {x.algorithm: x for x in (_once(f"{key}-{i}", f) for i, f in enumerate(factories))}

        def one(text: str) -> str:
            try:
                value = json.loads(text)
                signature = value.get("signature")
            except (ValueError, AttributeError):
                return "malformed"
            if not signature:
                return "unsigned"
            try:
                good = signers[signature["algorithm"]].verify(payload(text), str(signature["value"]))
            except Exception:  # noqa: BLE001
                return "invalid"
            return "valid" if good is True else "invalid"

        return s.map(one, na_action="ignore")

    return check(receipt_json)


def failed(decided: DataFrame) -> DataFrame:
    """How many decisions an evaluator could not make, by the kind of error."""
    return decided.filter("decision_error IS NOT NULL").groupBy("decision_error").agg(F.count(F.lit(1)).alias("n"))
