import pytest

from sluice.seclang.ast import SetVar
from sluice.seclang.errors import InvalidArgument, ParseError, RuleFileError, UnknownAction, UnknownOperator, UnknownTransformation, UnknownVariable
from sluice.seclang.parser import Parser, merge_actions, parse_actions, parse_operator, parse_variables, tokens
from sluice.seclang.ruleset import Metadata, Ruleset, chain_matches


def kinds(text):
    return [(t.kind, t.value) for t in tokens(text)]


@pytest.mark.parametrize("text, expected", [
    ("SecRule REQUEST_URI", [("directive", "SecRule"), ("word", "REQUEST_URI")]),
    ("Sec\\\nRule", [("directive", "SecRule")]),
    ("SecRule \\\n  REQUEST_URI", [("directive", "SecRule"), ("word", "REQUEST_URI")]),
    ('"hello \\"world\\""', [("quoted", 'hello "world"')]),
    ("'it\\'s'", [("quoted", "it's")]),
    ("# this is a comment\nSecRule", [("comment", ""), ("directive", "SecRule")]),
    ('"a\\n\\t\\d\\\\"', [("quoted", "a\n\t\\d\\")]),
    ('"a\\\n   b"', [("quoted", "ab")]),
    ('"a\\\r\n   b"', [("quoted", "ab")]),
    ('"open', [("quoted", "open")]),
    ("a\nb", [("word", "a"), ("newline", ""), ("word", "b")]),
    ("Include x", [("directive", "Include"), ("word", "x")]),
    ("x Include", [("word", "x"), ("word", "Include")]),
    ("SecRule\r\nSecRule", [("directive", "SecRule")]),  # a bare carriage return ends the text
    ("a \\b", [("word", "a"), ("word", "b")]),
    ("a\\b", [("word", "a\\b")]),
    ('ab"c"', [("word", "ab"), ("quoted", "c")]),
    ("", []),
])
def test_tokens(text, expected):
    assert kinds(text) == expected


def test_token_lines():
    assert [t.line for t in tokens('a "x\\\ny"\nb')] == [1, 1, 2, 3]


def test_variables():
    a = parse_variables("ARGS:username")[0]
    assert (a.name, a.key, a.pattern) == ("ARGS", "username", None)
    b = parse_variables("args:/^user/")[0]
    assert (b.name, b.key, b.pattern) == ("ARGS", None, "^user")
    assert parse_variables("&ARGS")[0].count
    assert [v.name for v in parse_variables("REQUEST_URI|ARGS|REQUEST_HEADERS")] == ["REQUEST_URI", "ARGS", "REQUEST_HEADERS"]
    assert [v.excluded for v in parse_variables("!ARGS:x|ARGS|TX")] == [("ARGS:x",)] * 2
    assert parse_variables("ARGS://")[0].key == "//"
    for bad in ("NOPE", "ARGS:/a|b/", "INBOUND_ANOMALY_SCORE"):
        with pytest.raises(UnknownVariable):
            parse_variables(bad)


@pytest.mark.parametrize("text, expected", [
    ("@rx ^admin", ("rx", "^admin", False)), ("^admin", ("rx", "^admin", False)), ("!@rx ^admin", ("rx", "^admin", True)), ("! ^a", ("rx", "^a", True)),
    ("@detectSQLi", ("detectsqli", "", False)), ("@pm  admin root user", ("pm", "admin root user", False)), ("", ("rx", "", False)),
])
def test_operators(text, expected):
    o = parse_operator(text)
    assert (o.name, o.argument, o.negated) == expected


def test_unknown_operator():
    with pytest.raises(UnknownOperator):
        parse_operator("@nope x")


def test_actions():
    assert len(parse_actions("id:1,deny,status:403")) == 3
    assert [a.value for a in parse_actions("id:1,msg:'Hello, world',deny")] == ["1", "Hello, world", None]
    assert [a.value for a in parse_actions("id:1,t:lowercase,t:urlDecode")][1:] == ["lowercase", "urlDecode"]
    assert parse_actions("msg:f(a,b),pass")[0].value == "f(a,b)"
    assert parse_actions("id:1,\\\n   deny")[1].name == "deny"
    assert parse_actions(" , ,deny, ")[0].name == "deny"
    assert parse_actions("severity:'CRITICAL'")[0].value == 2 and parse_actions("severity:7")[0].value == 7
    assert parse_actions("ctl:ruleEngine=Off")[0].value == ("ruleEngine", "Off")
    with pytest.raises(UnknownAction):
        parse_actions("explode")
    for bad in ("id:x", "id", "skip:-1", "skip", "redirect", "skipAfter", "phase:request", "severity:odd", "status:70000", "maturity:'9'", "setvar", "ctl"):
        with pytest.raises(InvalidArgument):
            parse_actions(bad)


@pytest.mark.parametrize("text, expected", [
    ("tx.score=+5", SetVar("tx", "score", "add", 5)), ("tx.score=-3", SetVar("tx", "score", "add", -3)), ("TX.a=7", SetVar("tx", "a", "set", "7")),
    ("!tx.a", SetVar("tx", "a", "delete")), ("tx.a", SetVar("tx", "a", "set", "1")), ("a=x y", SetVar("tx", "a", "set", "x y")), ("ip.a.b=1", SetVar("ip", "a.b", "set", "1")),
    ("'tx.s=+5'", SetVar("'tx", "s", "add", 1)), ("'tx.s=5'", SetVar("'tx", "s", "set", "5'")), ("'!tx.s'", SetVar("'!tx", "s'", "set", "1")),
    ("tx.a=+%{x}", SetVar("tx", "a", "add", 1)), ("tx.a=+07", SetVar("tx", "a", "add", 7)), ("tx.a=007", SetVar("tx", "a", "set", "7")),
])
def test_setvar(text, expected):
    assert parse_actions("setvar:" + text)[0].value == expected


def test_last_of_a_kind_wins():
    own = parse_actions("t:lowercase,t:trim,tag:a,tag:b,chain,skip:2,deny,pass,msg:m,log,nolog,setvar:a=1,setvar:b=2")
    kept = merge_actions((), own)
    assert [(a.name, a.value) for a in kept] == [
        ("t", "trim"), ("tag", "b"), ("skip", 2), ("pass", None), ("msg", "m"), ("nolog", None), ("setvar", SetVar("tx", "b", "set", "2"))]
    merged = merge_actions(parse_actions("phase:1,deny,t:trim,t:lowercase"), parse_actions("id:1,pass"))
    assert [a.name for a in merged] == ["phase", "t", "t", "id", "pass"]


def test_rulesets():
    two = Ruleset.from_string('SecRule REQUEST_URI "@rx a" "id:1,phase:1"\nSecRule ARGS "@rx b" "id:2,phase:2"')
    assert two.rule_count == 2 and [len(two.phases[p]) for p in (1, 2)] == [1, 1]
    assert Ruleset.from_string("SecRuleEngine DetectionOnly").mode == "DetectionOnly"
    assert Ruleset.from_string("SecRuleEngine Off\nSecRuleEngine on").mode == "On"
    assert Ruleset.from_string('SecRule ARGS "x" "id:1,phase:9"').phases[2][0].id == "1"
    assert Ruleset.from_string('SecRule ARGS "x"').phases[2][0].id is None
    r = Ruleset.from_string('SecDefaultAction "phase:1,t:lowercase,t:trim,setvar:a=1,setvar:b=1"\nSecRule ARGS "x"\nSecRule ARGS "x" "t:none"').phases[1]
    assert r[0].transformations == ("lowercase", "trim") and len(r[0].setvars) == 2 and r[1].transformations == ()


def test_chains_and_markers():
    r = Ruleset.from_string(
        'SecMarker A\nSecRule ARGS "x" "id:1,phase:1,chain"\nSecAction "phase:1"\nSecRule ARGS "y" "phase:1,chain"\nSecRule ARGS "z" "phase:1"\nSecMarker B\n'
        'SecRule ARGS "x" "phase:1,chain"\nSecRule ARGS "y" "phase:2"')
    assert [x.chain_next for x in r.phases[1]] == [2, None, 3, None, None]
    assert r.markers == {"A": (1, 0), "B": (1, 4)}
    truth = {"x": True, "y": True, "z": False}
    assert chain_matches(r.phases[1], 0, lambda rule: truth[rule.operator.argument]) is False
    truth["z"] = True
    assert chain_matches(r.phases[1], 0, lambda rule: truth[rule.operator.argument]) is True
    assert chain_matches(r.phases[1], 0, lambda rule: None) is None and chain_matches([], 0, lambda rule: True) is False


@pytest.mark.parametrize("text, error", [
    ("SecRule ARGS x", ParseError), ("SecRule", ParseError), ("hello", ParseError), ("SecRuleEngine maybe", ParseError), ("SecRequestBodyAccess perhaps", ParseError),
    ("SecRuleRemoveById 1 2", ParseError), ('SecRule ARGS "@rx"', InvalidArgument), ('SecRule ARGS "@pm "', InvalidArgument), ('SecRule ARGS "@ipMatch 1.2.3.4,1.2.3.5"', InvalidArgument),
    ('SecRule ARGS "@pmFromFile /no/file"', RuleFileError), ('SecRule ARGS "x" "t:nope"', UnknownTransformation), ('SecRule ARGS "x" "nope"', UnknownAction),
])
def test_bad_rules(text, error):
    with pytest.raises(error):
        Ruleset.from_string(text)


def test_other_lines_are_skipped():
    ok = Ruleset.from_string("SecRequestBodyAccess On\nSecResponseBodyAccess Off\nSecRuleRemoveById 1\nSecDebugLog /x \"y\" z\n" + 'SecRule ARGS "@rx (?=x" "id:1"\n')
    assert ok.rule_count == 1
    # a comment ends with its line, so after an unknown directive the next line goes too
    assert Ruleset.from_string('SecDebugLog x # why\nSecRule ARGS "x" "id:1"\nSecRule ARGS "x" "id:2"').phases[2][0].id == "2"


def test_files(tmp_path):
    (tmp_path / "b.conf").write_text('SecRule ARGS "x" "id:2"\n')
    (tmp_path / "a.conf").write_text('SecRule ARGS "x" "id:1"\n')
    (tmp_path / "main").write_text(f"Include b.conf\nInclude {tmp_path}/a*.conf\nInclude nothing*.conf\n")
    assert [r.id for r in Ruleset.from_file(str(tmp_path / "main")).phases[2]] == ["2", "1"]
    assert [r.id for r in Ruleset.from_glob(f"{tmp_path}/*.conf").phases[2]] == ["1", "2"]
    assert Ruleset.from_glob(f"{tmp_path}/*.none").rule_count == 0
    with pytest.raises(RuleFileError):
        Parser().file(str(tmp_path / "missing"))


def test_metadata_log():
    m = Metadata(id="1", msg="m", severity=2, tags=("a", "b"), rev="3", ver="v")
    assert m.format_log() == '[id "1"] [msg "m"] [severity "CRITICAL"] [tag "a"] [tag "b"] [rev "3"] [ver "v"]'
    assert Metadata().format_log() == ""
