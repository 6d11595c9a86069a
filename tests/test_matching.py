"""Tolerant presence: wrapping is fine, other values are not."""

import pytest

from lodestrata.functions.matching import is_present, missing

PRESENT = [
    ("improved throughput", "improved through-\nput"), ("3", "in 3 days"), ("SQL", "uses SQL."), ("https://example.com/abc", "https://exam\nple.com/abc"), ("数据分析", "数据 分析"), ("数据 分析", "数据分析"), ("B C", "BC"), ("a – b", "a–b"),
    ("”quoted” next", "”quoted”next"), ("well-known", "well-\nknown"), ("one two", "one\n  two"), ("ﬁne", "fine"), ("", "anything"), ("3.", "ends in 3."), ("−3%", "at −3% now"),
]
ABSENT = [("3", "3,000"), ("3", "3.9"), ("3", "-3"), ("3", "13"), ("3", "1e3"), ("3", "1,003"), ("3", ".3"), ("SQL", "NoSQL"), ("one two", "onetwo"), ("2021", "20215"), ("3.", "3.9"), ("Java", "JavaScript"), ("abc def", "abc  x def")]


@pytest.mark.parametrize(("want", "text"), PRESENT)
def test_present(want, text):
    assert is_present(want, text)


@pytest.mark.parametrize(("want", "text"), ABSENT)
def test_absent(want, text):
    assert not is_present(want, text)


def test_a_place_serves_one_text():
    assert missing(["led team", "led team"], "led team") == [1]
    assert missing(["team", "led team"], "led team") == [0]
    assert missing(["team", "led team"], "led team\nteam") == []
    assert missing(["", "x"], "") == [1]
