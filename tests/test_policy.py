import fnmatch
import re

import pytest
from pyspark.sql import functions as F

from veritrail.operators import policy

NOW = "2031-08-20T12:00:00Z"


def bundle(rules, unknown="deny", domain="access_control"):
    return policy.bundle({"version": 1, "policy_id": "p", domain: {"defaults": {"unknown_metadata": unknown}, "rules": rules}}, domain)


def decide(spark, rules, metas, **kw):
    df = spark.createDataFrame([(i, m) for i, m in enumerate(metas)], "i int, m map<string,string>")
    bound = policy.map_binding({"chunk.size": (F.lit(5), "number"), "chunk.on": (F.lit(True), "boolean")}, {"chunk": F.col("m")})
    d, fired = bundle(rules, **kw).compile(bound, F.lit(NOW))
    return [(r.d, r.f) for r in df.select("i", d.alias("d"), fired.alias("f")).orderBy("i").collect()]


def rule(name="r", when=None, require=None):
    return {"name": name, "when": when or {}, "require": require or {}, "on_violation": "deny"}


CASES = [
    ({"in": ["a", "b"]}, ["a", "c", None], ["allow", "deny", "deny"]),
    ({"not_in": ["a"]}, ["a", "c", None], ["deny", "allow", "allow"]),
    ("a", ["a", "A", None], ["allow", "deny", "deny"]),
    ({"not_older_than": " 41 h "}, ["2031-08-19T00:00:00Z", "2031-08-18T00:00:00Z", "2032-01-01T00:00:00Z", "junk", None], ["allow", "deny", "allow", "deny", "deny"]),
    ({"matches_pattern": "a*[0-9]"}, ["ab7", "ab", None, "A7"], ["allow", "deny", "deny", "deny"]),
    ({"not_matches_pattern": "x?z*"}, ["xyz9", "ok", None, "x" * 70000], ["deny", "allow", "deny", "deny"]),
    ({"length_at_most": 3}, ["abc", "abcd", None], ["allow", "deny", "deny"]),
    ({}, ["a"], ["deny"]),
    ({"length_at_most": 9, "in": ["z"]}, ["a"], ["deny"]),
]


@pytest.mark.parametrize("constraint,values,expect", CASES)
def test_require(spark, constraint, values, expect):
    got = decide(spark, [rule(require={"chunk.x": constraint})], [{"x": v} for v in values])
    assert [d for d, _ in got] == expect


def test_missing_follows_the_default(spark):
    for unknown in ("allow", "deny"):
        assert decide(spark, [rule(require={"chunk.x": "a"})], [{}, None], unknown=unknown) == [(unknown, ["r"])] * 2


def test_typed_equality(spark):
    assert decide(spark, [rule(require={"chunk.size": 5.0, "chunk.on": 1})], [{}])[0][0] == "allow"
    assert decide(spark, [rule(require={"chunk.size": "5"})], [{}])[0][0] == "deny"
    assert decide(spark, [rule(require={"chunk.x": 5})], [{"x": "5"}])[0][0] == "deny"


def test_fold_stops_at_the_first_violation(spark):
    rules = [rule("one", {"chunk.t": "x"}), rule("two", {"chunk.t": {"in": ["x"]}}, {"chunk.u": "1"}), rule("three")]
    got = decide(spark, rules, [{"t": "x", "u": "1"}, {"t": "x", "u": "2"}, {"t": "y"}, {"t": None}])
    assert got == [("allow", ["one", "two", "three"]), ("deny", ["one", "two"]), ("allow", ["three"]), ("allow", ["three"])]


def test_no_rules_allow(spark):
    assert decide(spark, [], [{}]) == [("allow", [])]


BAD = [
    {"version": 2, "policy_id": "p", "rules": []},
    {"version": 1, "policy_id": "", "rules": []},
    {"version": 1, "policy_id": "p", "rules": {}},
    {"version": 1, "policy_id": "p", "rules": [], "more": 1},
    {"version": 1, "policy_id": "p", "rules": [{"name": "r", "require": {"tool.name": "x"}}]},
    {"version": 1, "policy_id": "p", "rules": [{"name": "r", "require": {"any_of": []}}]},
    {"version": 1, "policy_id": "p", "rules": [{"name": "r", "require": {"chunk.x": {"like": "x"}}}]},
    {"version": 1, "policy_id": "p", "rules": [{"name": "r", "require": {"chunk.x": {"not_older_than": "9w"}}}]},
    {"version": 1, "policy_id": "p", "rules": [{"name": "r", "require": {"chunk.x": {"in": "x"}}}]},
    {"version": 1, "policy_id": "p", "rules": [{"name": "r", "require": {"request.session_id": "x"}}]},
    {"version": 1, "policy_id": "p", "rules": [{"name": "r", "on_violation": "warn"}]},
    {"version": 1, "policy_id": "p", "rules": [{"name": "r", "description": "why"}]},
    {"policy_id": "p", "rules": []},
    {"version": 1, "policy_id": "p", "access_control": []},
    {"version": 1, "access_control": {"rules": []}},
    {"version": 1, "policy_id": "p", "access_control": {"rules": []}, "verification": {"block_unauthroized": True}},
    {"version": 1, "policy_id": "p", "verification": {"block_stale": 1}},
    {"version": 1, "policy_id": "p", "verification": ["block_stale"]},
    [],
]


@pytest.mark.parametrize("document", BAD)
def test_bad_bundles_raise(document):
    with pytest.raises(policy.PolicyError):
        policy.bundle(document, "access_control")


def test_yaml_and_version_hash():
    pytest.importorskip("yaml")
    text = "version: 1\npolicy_id: p\naccess_control:\n  rules:\n    - name: r\n      require: {chunk.x: {not_older_than: 36h}}\n"
    a, b = policy.bundle(text, "access_control"), policy.bundle({"access_control": {"rules": [{"require": {"chunk.x": {"not_older_than": "36h"}}, "name": "r"}]}, "policy_id": "p", "version": 1, "verification": {}}, "access_control")
    assert a.version_hash == b.version_hash and a.version_hash.startswith("sha256:")
    with pytest.raises(policy.PolicyError):
        policy.load_yaml("a: [")


PATTERNS = ["*", "a*", "?b", "[abc]x", "[!a]*", "a[", "a|b", "(x)", "*.[0-9]", "[]]", "[!]]a", "a&&b", "x\\y", "[z-a]"]
VALUES = ["", "a", "ab", "xb", "ax", "bx\n", "a[", "a|b", "(x)", "v.7", "]", "ba", "a&&b", "x\\y", "\n"]


def test_globs_like_python(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "v string")
    for p in PATTERNS:
        got = {r.v: r.m for r in df.select("v", F.col("v").rlike(policy.glob_regex(p)).alias("m")).collect()}
        assert got == {v: fnmatch.fnmatchcase(v, p) for v in VALUES}, p


def test_verification_policy(spark):
    df = spark.createDataFrame([(o,) for o in ("VERIFIED", "STALE", "UNAUTHORIZED", "UNVERIFIED", "TAMPERED")], "o string")
    p = policy.VerificationPolicy(block_unverified=True)
    assert [r[0] for r in df.select(p.blocks(F.col("o"))).collect()] == [False, False, True, True, True]
    assert [r[0] for r in df.select(p.flags(F.col("o"))).collect()] == [False, True, True, True, True]
    assert policy.coerce_policy(None) == policy.Policy() and policy.coerce_policy(p) == policy.Policy(p)
    with pytest.raises(TypeError):
        policy.coerce_policy(3)
    assert re.match("sha256:", policy.NULL_BUNDLES["access_control"].version_hash)


def typed(spark, rules, metas, **kw):
    df = spark.createDataFrame(list(enumerate(metas)), "i int, m string")
    d, _ = bundle(rules, **kw).compile(policy.json_binding({}, {"chunk.metadata": F.col("m")}), F.lit(NOW))
    return [r.d for r in df.select("i", d.alias("d")).orderBy("i").collect()]


def test_json_values_keep_their_types(spark):
    flag = [rule(when={"chunk.metadata.pii": True}, require={"chunk.metadata.never": "x"})]
    assert typed(spark, flag, ['{"pii":true}', '{"pii":false}', '{"pii":"true"}', '{"pii":1}', "{}", "junk", None, '{"pii":null}']) == ["deny", "allow", "allow", "deny", "allow", "allow", "allow", "allow"]
    need = lambda x: [rule(require={"chunk.metadata.a.b": x})]
    assert typed(spark, need(5), ['{"a":{"b":5}}', '{"a":{"b":5.0}}', '{"a":{"b":"5"}}', '{"a":5}', '{"a":{"b":{"c":5}}}']) == ["allow", "allow", "deny", "deny", "deny"]
    assert typed(spark, need({"in": ["x", None, 1]}), ['{"a":{"b":"x"}}', '{"a":{"b":null}}', '{"a":{"b":true}}', '{"a":{"b":"1"}}']) == ["allow", "allow", "allow", "deny"]
    assert typed(spark, need({"matches_pattern": "x*"}), ['{"a":{"b":"xy"}}', '{"a":{"b":7}}', '{"a":{"b":null}}']) == ["allow", "deny", "deny"]
    assert typed(spark, need({"length_at_most": 2}), ['{"a":{"b":"xy"}}', '{"a":{"b":"xyz"}}', '{"a":{"b":1}}']) == ["allow", "deny", "deny"]
    assert typed(spark, need({"not_older_than": "36h"}), ['{"a":{"b":"2031-08-19T13:00:00Z"}}', '{"a":{"b":1}}']) == ["allow", "deny"]


def test_conditions_that_cannot_be_met_are_errors(spark):
    for literal in (True, 5, {"in": ["x", 1]}):
        with pytest.raises(policy.PolicyError):
            decide(spark, [rule(when={"chunk.x": literal})], [{"x": "true"}])
    with pytest.raises(policy.PolicyError):
        typed(spark, [rule(when={"chunk.metadata.x": ["a"]})], ["{}"])


def test_documents_are_read_whole(spark, tmp_path):
    p = policy.load({"policy_id": "p", "verification": {"block_stale": True, "block_tampered": False}, "tool_call_control": {"rules": [rule("t", require={"tool.name": "x"})]}})
    assert p.verification == policy.VerificationPolicy(block_stale=True, block_tampered=False)
    assert p.access_control is None and [r.name for r in p.tool_call_control.rules] == ["t"] and list(p.hashes()) == ["tool_call_control"]
    assert policy.load({"version": 1, "verification": {"flag_stale": False}}).verification.flag_stale is False
    assert policy.load({"version": 1, "access_control": {"policy_id": "inner"}}).access_control.policy_id == "inner"
    top = policy.load({"version": 1, "policy_id": "p", "rules": [rule()]})
    assert top.access_control.rules[0].name == "r" and policy.load({}) == policy.Policy()
    a, b = (policy.load({"version": 1, "policy_id": "p", "access_control": {"rules": []}, **more}).hashes() for more in ({}, {"verification": {"block_stale": True}}))
    assert a == b  # the halves have versions of their own
    for bad in ({"verification": {"typo": True}}, {"version": 3}, {"verification": {}, "rules": []}, {"tool_call_control": {"rules": []}}, []):
        with pytest.raises(policy.PolicyError):
            policy.load(bad)


def test_gate_comes_before_access(spark):
    p = policy.load({"version": 1, "policy_id": "p", "verification": {"block_stale": True}, "access_control": {"rules": [rule(require={"chunk.x": "a"})]}})
    df = spark.createDataFrame([("VERIFIED", "a"), ("VERIFIED", "b"), ("STALE", "a"), ("UNVERIFIED", "a"), ("TAMPERED", "b")], "o string, x string")
    admitted, flagged, fired = p.admits(F.col("o"), policy.map_binding({}, {"chunk": F.create_map(F.lit("x"), F.col("x"))}), F.lit(NOW))
    got = [tuple(r) for r in df.select(admitted, flagged, F.size(fired)).collect()]
    assert got == [(True, False, 1), (False, False, 1), (False, True, 0), (True, True, 1), (False, True, 0)]
    open_gate = policy.Policy(policy.VerificationPolicy(block_tampered=False))
    assert [r[0] for r in df.select(open_gate.admits(F.col("o"), policy.map_binding({}, {}), F.lit(NOW))[0]).collect()] == [True] * 5


def test_files_are_validated(tmp_path):
    pytest.importorskip("yaml")
    good, typo, broken = (tmp_path / n for n in ("good.yaml", "typo.yaml", "broken.yaml"))
    good.write_text("policy_id: p\nverification: {block_stale: true}\naccess_control:\n  rules: []\n")
    typo.write_text("policy_id: p\nverification: {block_unauthroized: true}\n")
    broken.write_text("a: [")
    assert policy.validate(str(good)) is None and policy.load_file(str(good)).verification.block_stale
    assert "block_unauthroized" in policy.validate(str(typo))
    assert policy.validate(str(broken)) and "cannot read" in policy.validate(str(tmp_path / "none.yaml"))


def test_version_mismatch_is_a_default():
    made = policy.bundle({"version": 1, "policy_id": "p", "rules": [], "defaults": {"unknown_metadata": "allow", "policy_version_mismatch": "allow"}}, "access_control")
    assert (made.unknown, made.version_mismatch) == ("allow", "allow")
    for bad in ({"policy_version_mismatch": "warn"}, {"other": "deny"}, ["deny"]):
        with pytest.raises(policy.PolicyError):
            policy.bundle({"version": 1, "policy_id": "p", "rules": [], "defaults": bad}, "access_control")
