"""Rule bundles compiled to Columns.

A bundle is a dict (or YAML text): version 1, policy_id, rules with name,
``when``, ``require`` and ``on_violation: deny``, and defaults. The driver
validates it once and turns each rule into two Columns that are never null:
whether it applies and whether it is violated. The decision is then the least
number of a violated rule, all inside generated code.

Paths resolve through a :class:`Binding`, which says for a path which Column
holds it and whether it is present, so that a missing value and an explicit null
stay different.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritrail.functions.canon import canonical_json, sha256_text
from veritrail.functions.times import instant

#: Fixed values of the rule language.
GLOB_INPUT_LIMIT = 65536
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
OPERATORS = ("in", "not_in", "not_older_than", "matches_pattern", "not_matches_pattern", "length_at_most")
RESERVED = ("any_of", "all_of", "not", "nested")
ROOTS = {"access_control": ("chunk", "request"), "tool_call_control": ("tool", "request")}
TOP_KEYS = ("version", "policy_id", "description", "verification", "access_control", "tool_call_control")
HALF_KEYS = ("rules", "defaults")
DEFAULTS = ("unknown_metadata", "policy_version_mismatch")


class PolicyError(ValueError):
    """A bundle that cannot be compiled."""


def seconds(text) -> int:
    """Length of a duration such as 90d, 24h, 30m or 10s; white space around number and unit does not matter."""
    m = re.fullmatch(r"\s*(\d+)\s*([smhd])\s*", text) if isinstance(text, str) else None
    if not m:
        raise PolicyError(f"not a duration: {text!r}")
    return int(m[1]) * UNITS[m[2]]


def glob_regex(pattern: str) -> str:
    """A Java regular expression for a case-sensitive glob: * ? [set] [!set]; an unclosed [ stands for itself."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            if out[-1:] != [".*"]:
                out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            j = i + (pattern[i : i + 1] == "!")
            j = pattern.find("]", j + (pattern[j : j + 1] == "]"))
            if j < 0:
                out.append("\\[")
                continue
            body, i = pattern[i:j], j + 1
            negate, body = body[:1] == "!", body.removeprefix("!")
            ranges, k = [], 0
            while k < len(body):
                lo = hi = body[k]
                if k + 2 < len(body) and body[k + 1] == "-":
                    hi = body[k + 2]
                    k += 2
                k += 1
                if lo <= hi:
                    ranges.append(f"\\x{{{ord(lo):x}}}-\\x{{{ord(hi):x}}}")
            if ranges:
                out.append(f"[{'^' * negate}{''.join(ranges)}]")
            else:
                out.append("." if negate else "(?!)")
        else:
            out.append(re.sub(r"[^A-Za-z0-9]", lambda m: f"\\x{{{ord(m[0]):x}}}", c))
    return f"(?s)\\A{''.join(out)}\\z"


@dataclass(frozen=True)
class Value:
    """A resolved path: the Column, whether it is there, and its kind (string, number, boolean, variant or other).

    ``untyped`` says that the value is a text whatever it was before, as in a map of strings.
    """

    column: Column
    present: Column
    kind: str = "string"
    untyped: bool = False


Binding = Callable[[str], Value]


def _literal_kind(v) -> str:
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    return "string" if isinstance(v, str) else "other"


def _equals(value: Value, literal) -> Column:
    """Equality of values of like kinds; booleans equal the numbers 0 and 1, a text never equals a number."""
    if literal is None:
        return F.is_variant_null(value.column) if value.kind == "variant" else value.column.isNull()
    kind = _literal_kind(literal)
    if value.kind == "variant":
        return _variant_equals(value.column, kind, literal)
    if kind == value.kind:
        return value.column.eqNullSafe(F.lit(literal))
    if {kind, value.kind} == {"boolean", "number"}:
        return value.column.cast("double").eqNullSafe(F.lit(float(literal)))
    return F.lit(False)


def _typed(column: Column, kind: str) -> Column:
    """A variant as string, boolean or number (a boolean is 0 or 1); null where it is of another type."""
    found = F.schema_of_variant(column)
    if kind == "number":
        number = F.when(found == "BOOLEAN", F.try_variant_get(column, "$", "boolean").cast("double"))
        return number.when(found.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(column, "$", "double"))
    return F.when(found == {"string": "STRING", "boolean": "BOOLEAN"}[kind], F.try_variant_get(column, "$", kind))


def _variant_equals(column: Column, kind: str, literal) -> Column:
    if kind == "other":
        return F.lit(False)
    number = kind in ("boolean", "number")
    return F.coalesce(_typed(column, "number") == F.lit(float(literal)) if number else _typed(column, "string") == F.lit(literal), F.lit(False))


def _member(value: Value, literals: list) -> Column:
    out = F.lit(False)
    for x in literals:
        out = out | _equals(value, x)
    return out


def _age(value: Value, limit: int, now: Column) -> Column:
    if value.kind not in ("string", "variant"):
        return F.lit(False)
    text = _typed(value.column, "string") if value.kind == "variant" else value.column
    return F.coalesce(F.unix_seconds(instant(now)) - F.unix_seconds(instant(text)) <= limit, F.lit(False))


def _satisfies(value: Value, constraint, now: Column) -> Column:
    """Whether a present value meets a ``require`` constraint; of several operators in one mapping the first counts."""
    if not isinstance(constraint, Mapping):
        return _equals(value, constraint)
    text = value.kind in ("string", "variant")
    column = _typed(value.column, "string") if value.kind == "variant" else value.column
    for op in OPERATORS:
        if op not in constraint:
            continue
        x = constraint[op]
        if op == "in":
            return _member(value, x)
        if op == "not_in":
            return ~_member(value, x)
        if op == "not_older_than":
            return _age(value, seconds(x), now)
        if not text:
            return F.lit(False)
        if op == "length_at_most":
            return F.coalesce(F.length(column) <= int(x), F.lit(False))
        usable = F.coalesce(F.length(column) <= GLOB_INPUT_LIMIT, F.lit(False))
        hit = F.coalesce(column.rlike(glob_regex(x)), F.lit(False))
        return usable & (hit if op == "matches_pattern" else ~hit)
    return F.lit(False)


def _applies(value: Value, constraint) -> Column:
    """Whether a rule applies; a condition that no value here could ever meet is an error, as the rule would silently allow."""
    literals = constraint.get("in", []) if isinstance(constraint, Mapping) else [constraint]
    if any(_literal_kind(x) == "other" for x in literals if x is not None):
        raise PolicyError(f"when compares with texts, numbers, booleans or null: {constraint!r}")
    if value.untyped and any(_literal_kind(x) in ("boolean", "number") for x in literals):
        raise PolicyError(f"a map of texts cannot meet {constraint!r}; bind the metadata as JSON")
    if isinstance(constraint, Mapping):
        return value.present & _member(value, constraint["in"]) if "in" in constraint else F.lit(False)
    return value.present & _equals(value, constraint)


@dataclass(frozen=True)
class Rule:
    name: str
    when: Mapping = field(default_factory=dict)
    require: Mapping = field(default_factory=dict)


def _check_path(path, domain: str) -> None:
    if not isinstance(path, str) or "." not in path or any(not p for p in path.split(".")):
        raise PolicyError(f"not a path: {path!r}")
    if path in RESERVED or path.split(".")[0] not in ROOTS[domain]:
        raise PolicyError(f"{domain} rules cannot read {path!r}")
    if path == "request.session_id":
        raise PolicyError("session_id is no rule input")


def _check_constraint(constraint, where: str) -> None:
    if not isinstance(constraint, Mapping):
        return
    allowed = ("in",) if where == "when" else OPERATORS
    if unknown := set(constraint) - set(allowed):
        raise PolicyError(f"unknown operators in {where}: {sorted(unknown)}")
    for op, x in constraint.items():
        if op in ("in", "not_in") and not isinstance(x, list):
            raise PolicyError(f"{op} takes a list")
        if op in ("matches_pattern", "not_matches_pattern") and not isinstance(x, str):
            raise PolicyError(f"{op} takes a text")
        if op == "length_at_most" and (isinstance(x, bool) or not isinstance(x, int) or x < 0):
            raise PolicyError(f"{op} takes a number")
        if op == "not_older_than":
            seconds(x)


@dataclass(frozen=True)
class Bundle:
    """The validated half of a policy for one domain."""

    policy_id: str
    domain: str
    rules: tuple[Rule, ...]
    unknown: str
    version_hash: str
    version_mismatch: str = "deny"

    def compile(self, binding: Binding, now: Column) -> tuple[Column, Column]:
        """Decision (allow or deny) and names of the rules that fired, up to the first violated one."""
        applied, numbers = [], [F.lit(None).cast("int"), F.lit(None).cast("int")]
        for i, rule in enumerate(self.rules):
            fires = F.lit(True)
            for path, constraint in rule.when.items():
                fires = fires & _applies(binding(path), constraint)
            broken = F.lit(False)
            for path, constraint in rule.require.items():
                v = binding(path)
                missing = F.lit(self.unknown == "deny")
                broken = broken | F.when(v.present, ~_satisfies(v, constraint, now)).otherwise(missing)
            applied.append(fires)
            numbers.append(F.when(fires & broken, F.lit(i)))
        first = F.least(*numbers)
        last = F.coalesce(first, F.lit(len(self.rules)))
        fired = F.array_compact(F.array(*[F.when(f & (F.lit(i) <= last), F.lit(r.name)) for i, (r, f) in enumerate(zip(self.rules, applied))])) if self.rules else F.array().cast("array<string>")
        return F.when(first.isNull(), "allow").otherwise("deny"), fired


def load_yaml(text: str) -> dict:
    try:
        import yaml
    except ImportError as e:  # the only optional part
        raise PolicyError("reading YAML needs PyYAML") from e
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise PolicyError(str(e)) from e


def bundle(document: Mapping | str, domain: str) -> Bundle:
    """Validate a policy document and take its half for ``domain``; the rules may also stand at the top."""
    if isinstance(document, str):
        document = load_yaml(document)
    if not isinstance(document, Mapping):
        raise PolicyError("a policy is a mapping")
    unified = any(k in document for k in (*ROOTS, "verification"))
    version = document.get("version", 1 if unified else None)
    if version != 1 or isinstance(version, bool):
        raise PolicyError("version must be 1")
    if unknown := set(document) - set(TOP_KEYS if unified else TOP_KEYS[:3] + HALF_KEYS):
        raise PolicyError(f"unknown keys: {sorted(unknown)}")
    verification(document.get("verification"))
    half = (document[domain] if document.get(domain) is not None else {}) if unified else {k: document[k] for k in HALF_KEYS if k in document}
    if not isinstance(half, Mapping) or set(half) - {*HALF_KEYS, "policy_id"}:
        raise PolicyError(f"{domain} has {' and '.join(HALF_KEYS)}")
    half = dict(half)
    nested = half.pop("policy_id", None)
    policy_id = document.get("policy_id") or nested
    if not isinstance(policy_id, str) or not policy_id:
        raise PolicyError("policy_id is missing")
    if unified:
        half.setdefault("rules", [])
    if not isinstance(half.get("rules"), list):
        raise PolicyError("rules must be a list")
    defaults = half.get("defaults") or {}
    if not isinstance(defaults, Mapping) or set(defaults) - set(DEFAULTS) or any(x not in ("allow", "deny") for x in defaults.values()):
        raise PolicyError(f"defaults has {' and '.join(DEFAULTS)}, each allow or deny")
    rules = []
    for r in half["rules"]:
        if not isinstance(r, Mapping) or set(r) - {"name", "when", "require", "on_violation"} or not isinstance(r.get("name"), str) or not r["name"]:
            raise PolicyError(f"not a rule: {r!r}")
        if r.get("on_violation", "deny") != "deny":
            raise PolicyError("on_violation must be deny")
        when, require = r.get("when") or {}, r.get("require") or {}
        for where, part in (("when", when), ("require", require)):
            if not isinstance(part, Mapping):
                raise PolicyError(f"{where} must be a mapping")
            for path, constraint in part.items():
                _check_path(path, domain)
                _check_constraint(constraint, where)
        rules.append(Rule(r["name"], when, require))
    if len({r.name for r in rules}) != len(rules):
        raise PolicyError("rule names must differ")
    normal = {"version": version, "policy_id": policy_id} | {k: document[k] for k in ("description",) if k in document} | half
    return Bundle(policy_id, domain, tuple(rules), defaults.get("unknown_metadata", "deny"), sha256_text(canonical_json(json.loads(json.dumps(normal)))), defaults.get("policy_version_mismatch", "deny"))


def map_binding(fields: Mapping[str, tuple[Column, str]], maps: Mapping[str, Column]) -> Binding:
    """Paths to plain columns (always present) and into string maps (present where the key is)."""

    def resolve(path: str) -> Value:
        if path in fields:
            column, kind = fields[path]
            return Value(column, F.lit(True), kind)
        root, _, key = path.rpartition(".")
        if root in maps:
            m = maps[root]
            return Value(F.try_element_at(m, F.lit(key)), F.coalesce(F.map_contains_key(m, key), F.lit(False)), untyped=True)
        return Value(F.lit(None).cast("string"), F.lit(False))

    return resolve


def json_binding(fields: Mapping[str, tuple[Column, str]], documents: Mapping[str, Column]) -> Binding:
    """Paths to plain columns and into JSON texts, whose values keep their types at any depth.

    A key that is there with null is present; a path through what is no object,
    and any path into a text that is no JSON, is missing.
    """
    parsed = {root: F.try_parse_json(c) for root, c in documents.items()}

    def resolve(path: str) -> Value:
        if path in fields:
            column, kind = fields[path]
            return Value(column, F.lit(True), kind)
        for root, v in parsed.items():
            if path.startswith(f"{root}."):
                keys = path[len(root) + 1 :].split(".")
                if any(set("'\\[]\"") & set(k) for k in keys):
                    raise PolicyError(f"not a path into JSON: {path!r}")
                found = F.try_variant_get(v, "$" + "".join(f"['{k}']" for k in keys), "variant")
                return Value(found, found.isNotNull(), "variant")
        return Value(F.lit(None).cast("string"), F.lit(False))

    return resolve


@dataclass(frozen=True)
class VerificationPolicy:
    """Which outcomes block a chunk and which are noted; flags never change a status."""

    block_stale: bool = False
    block_unauthorized: bool = True
    block_unverified: bool = False
    block_tampered: bool = True
    flag_stale: bool = True
    flag_unauthorized: bool = True
    flag_unverified: bool = True
    flag_tampered: bool = True

    def _among(self, outcome: Column, prefix: str) -> Column:
        on = [n.upper() for n in ("stale", "unauthorized", "unverified", "tampered") if getattr(self, f"{prefix}_{n}")]
        return outcome.isin(on) if on else F.lit(False)

    def blocks(self, outcome: Column) -> Column:
        return self._among(outcome, "block")

    def flags(self, outcome: Column) -> Column:
        return self._among(outcome, "flag")


NULL_BUNDLES = {d: Bundle("none", d, (), "allow", sha256_text("{}")) for d in ROOTS}


def verification(block) -> VerificationPolicy:
    """The verification half of a policy document; what is left out keeps its default, anything unknown is an error."""
    if block is None:
        return VerificationPolicy()
    if not isinstance(block, Mapping):
        raise PolicyError("verification must be a mapping")
    if unknown := set(block) - {f.name for f in fields(VerificationPolicy)}:
        raise PolicyError(f"unknown keys in verification: {sorted(map(str, unknown))}")
    if wrong := [k for k, v in block.items() if not isinstance(v, bool)]:
        raise PolicyError(f"verification takes true or false: {wrong}")
    return VerificationPolicy(**block)


@dataclass(frozen=True)
class Policy:
    """Everything a policy document says: the gate on outcomes, and the rules of each domain where it has any."""

    verification: VerificationPolicy = field(default_factory=VerificationPolicy)
    access_control: Bundle | None = None
    tool_call_control: Bundle | None = None

    def decide(self, domain: str, binding: Binding, now: Column) -> tuple[Column, Column]:
        """As :meth:`Bundle.compile`; a domain without rules allows."""
        return (getattr(self, domain) or NULL_BUNDLES[domain]).compile(binding, now)

    def admits(self, outcome: Column, binding: Binding, now: Column) -> tuple[Column, Column, Column]:
        """Whether a verified chunk passes both halves, whether its outcome is noted, and the rules that fired.

        A chunk that the gate blocks is not asked for access, so no rule fires for it.
        """
        decision, fired = self.decide("access_control", binding, now)
        blocked = self.verification.blocks(outcome)
        none = F.array().cast("array<string>")
        return ~blocked & (decision == "allow"), self.verification.flags(outcome), F.when(blocked, none).otherwise(fired)

    def hashes(self) -> dict[str, str]:
        """The version hash of each half that has rules; the halves have versions of their own."""
        return {d: b.version_hash for d in ROOTS if (b := getattr(self, d)) is not None}


def load(document: Mapping | str) -> Policy:
    """Validate a policy document (mapping or YAML text) whole: all halves, known keys, known flags.

    Rules may also stand at the top, for access control alone.
    """
    if isinstance(document, str):
        document = load_yaml(document)
    if not isinstance(document, Mapping):
        raise PolicyError("a policy is a mapping")
    if "rules" in document:
        return Policy(access_control=bundle(document, "access_control"))
    halves = {d: bundle(document, d) for d in ROOTS if document.get(d) is not None}
    if not halves:  # nothing but the gate: a policy needs no name then
        bundle({**document, "policy_id": document.get("policy_id") or "none", "verification": document.get("verification")}, "access_control")
    return Policy(verification(document.get("verification")), **halves)


def load_file(path: str) -> Policy:
    """The policy in a YAML file on the driver."""
    try:
        with open(path, encoding="utf-8") as f:
            return load(f.read())
    except OSError as e:
        raise PolicyError(f"cannot read {path}: {e.strerror}") from e


def validate(path: str) -> str | None:
    """What is wrong with a policy file, or None; for checks before a policy is deployed."""
    try:
        load_file(path)
    except PolicyError as e:
        return str(e)
    return None


def coerce_policy(value) -> Policy:
    """A policy from a policy, from its verification half alone, or the default from None."""
    if value is None:
        return Policy()
    if isinstance(value, VerificationPolicy):
        return Policy(value)
    if isinstance(value, Policy):
        return value
    raise TypeError(f"not a policy: {type(value).__name__}")
