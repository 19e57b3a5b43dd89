"""Python patterns against their Java forms."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tabvet.plans.regex import PatternError, python_regex_to_java
from tabvet.plans.rules import RuleError, load_rules

PATTERNS = [
    "^[A-Za-z0-9_-]+$", "^[A-Z]{2}$", "[[a-z]+$", "[a-z&&[^b]]+", "[]a]+", "[^]a]+", r"\d+", r"\D", r"\w+$", r"\W", r"\s", r"\S+", r"[\d\s]+", r"[^\d\s]+", r"[\W]", r"[^\W\d]+",
    r"\bab\b", r"a\B", "a.c", "(?s)a.c", "a$", r"a\Z", "(?m)^b$", "(?i)ÄB", "(?a)\\w+$", r"(?P<x>a|b)(?P=x)", r"(a)(b)?\1", "(?:ab)*?c", "a{,2}b", "a{2}", "(?=ab)a", "(?!ab)a",
    r"(?<=a)b", r"(?<!a)b", r"\101", r"\x41é", "(?x) a  b # note", "#a b", "a++b", "(?>a+)b", "(?i:a)B", "x|y|", "", r"\.", r"[.\-\]]", "é+", "漢", "😀", r"(a)\g" if False else "a/b",
    "a|^b", r"(\w)\1", r"[\s\-]", "[a-]", "\\\\", "{", "a{", "}", "]",
]
ALPHABET = ["a", "b", "c", "A", "B", "Z", "ab", "0", "9", "٣", "é", "É", "ä", "Ä", "漢", "😀", " ", "\t", "\n", "\r", "\x85", "\xa0", " ", "\x1c", ".", "-", "_", "[", "]", "&", "\\", "{", "}", "/", "#", "$", "^", "²", "́"]


def test_same_matches_as_python(spark):
    rng = random.Random(1)
    values = ["", *ALPHABET, *("".join(rng.choices(ALPHABET, k=rng.randrange(1, 6))) for _ in range(1500))]
    df = spark.createDataFrame([(v,) for v in values], "s string")
    java = ["^(?:" + python_regex_to_java(p) + ")" for p in PATTERNS]
    rows = df.select("s", *[F.col("s").rlike(j).alias(f"m{k}") for k, j in enumerate(java)]).collect()
    for row in rows:
        for p, got in zip(PATTERNS, row[1:]):
            assert got == bool(re.match(p, row.s)), (p, row.s)


@pytest.mark.parametrize("bad", ["[a", "(a", "a**", "(?P<x", r"(a)?(?(1)b|c)", r"\g", "(?<=a*)b"])
def test_refused_when_rules_are_loaded(bad):
    with pytest.raises(PatternError):
        python_regex_to_java(bad)
    with pytest.raises(RuleError):
        load_rules({"datasets": {"t": {"fields": [{"name": "s", "constraints": {"regex": bad}}]}}}, "t")
