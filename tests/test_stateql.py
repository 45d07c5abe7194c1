"""The state language's parser and its odd corners."""

import re

import pytest

from tracewright.plans.stateql import Field, Literal, Logic, StateQueryError, like_pattern, parse, tokenize

HEAD = "STATE s FOR LEADING OBJECT TYPE 'My Type' AS CASE "


def test_parse():
    q = parse(HEAD + "WHEN NOT event.a = 'it''s' OR object.\"Odd Name\" IS NOT NULL AND TRUE = bare THEN object.x ELSE -1.5 END;")
    assert q.leading_type == "My Type" and q.otherwise == Literal(-1.5) and q.branches[0][1] == Field("object", "x")
    either = q.branches[0][0]
    assert either.op == "OR" and either.parts[0].op == "NOT" and either.parts[0].parts[0].right == Literal("it's")
    assert isinstance(either.parts[1], Logic) and either.parts[1].parts[0].value == Field("object", "odd name")


def test_tokens():
    assert tokenize("a-b -- gone\n<> 'x'") == [("ident", "a-b"), ("op", "<>"), ("string", "x")]


@pytest.mark.parametrize("text", ["", "STATE", HEAD + "END", HEAD + "WHEN a THEN 1 END", HEAD + "WHEN a = THEN 1 END", HEAD + "WHEN (a = 1 THEN 1 END", HEAD + "WHEN a = 'x THEN 1 END", HEAD + "WHEN a = 1 THEN 2 END x", HEAD + "WHEN a ? 1 THEN 2 END"])
def test_errors(text):
    with pytest.raises(StateQueryError):
        parse(text)


def leftmost(value: str, pattern: str) -> bool:
    """The rule in plain words: segments in turn, each at its leftmost place, and nothing left over."""
    parts, at = pattern.lower().split("%"), 0
    value = value.lower()
    if len(parts) == 1:
        return value == parts[0]
    for i, p in enumerate(parts):
        found = value.find(p, at) if p else at
        if found < 0 or i == 0 and p and found:
            return False
        at = found + len(p)
    return parts[-1] == "" or at == len(value)


def test_like_goes_leftmost_without_going_back():
    for value in ["aba", "ab", "", "abab", "a_b", "Open Cart"]:
        for pattern in ["%a", "a%", "%b%", "a%b", "%ab", "ab", "a_b", "%", "%a%a%", "o%t"]:
            regex = like_pattern(pattern).replace("\\z", "\\Z")
            regex = re.sub(r"\\Q(.*?)\\E", lambda m: re.escape(m[1]), regex)
            assert bool(re.search(regex, value.lower())) == leftmost(value, pattern), (value, pattern)
