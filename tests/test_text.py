from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sluiceway.operators.rows import tokenize

GOLDEN = [
    ("--ab c--", ["", "ab", "c"]),
    ("---", []),
    ("", [""]),
    ("Whether 'tis", ["whether", "tis"]),
    ("Iechä. üb", ["iech", "b"]),
    ("a", ["a"]),
    ("a-", ["a"]),
    ("-a", ["", "a"]),
    ("snake_case 9\nnew\tline", ["snake_case", "9", "new", "line"]),
]


def split_words(text: str) -> list[str]:
    if text == "":
        return [""]
    parts = re.split(r"[^a-zA-Z0-9_]+", text.lower())
    while parts and parts[-1] == "":
        parts.pop()
    return parts


def tokens(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {i: [] for i in range(len(texts))}
    for row in tokenize(df, "text").orderBy("doc_id", "pos").collect():
        got[row.doc_id].append((row.pos, row.word))
    return [got[i] for i in range(len(texts))]


def test_golden_words(spark):
    got = tokens(spark, [t for t, _ in GOLDEN])
    assert [[w for _, w in ws] for ws in got] == [ws for _, ws in GOLDEN]
    assert all([p for p, _ in ws] == list(range(1, len(ws) + 1)) for ws in got)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aB_9- .,\n'éß", max_size=12), min_size=1, max_size=60))
def test_any_text(spark, texts):
    assert [[w for _, w in ws] for ws in tokens(spark, texts)] == [split_words(t) for t in texts]


def test_null_text_has_no_words(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert tokenize(df, "text").count() == 0


@pytest.mark.parametrize("text", ["x y " * 20_000])
def test_whole_text_is_used(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert tokenize(df, "text").count() == 40_000
