import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmark.functions import constants as K
from quillmark.functions import text as T
from quillmark.operators import global_search, search


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_words(spark):
    assert column(spark, ["Straße naïve x² _a b", "", "a--b", "İ"], T.words)[:3] == [["straße", "naïve", "x²", "_a", "b"], [], ["a", "b"]]


def test_query_terms(spark):
    assert column(spark, ["How is the", "alpha Alpha, of xy"], T.query_terms) == [[], ["alpha", "alpha"]]
    assert search.terms_of("alpha Alpha, of xy") == ["alpha", "alpha"]


def test_expansion_is_one_hop(spark):
    assert sorted(column(spark, [["install", "api"]], T.expanded, "array<string>")[0]) == sorted(["install", "api", *K.SYNONYMS["install"], *K.SYNONYMS["api"]])
    assert search.expand(["run", "run"]) == ["run", "execute", "start", "launch"]


def test_cleaner_cuts_phrases_inside_words(spark):
    asked = ["widget", "How do I get the config", "of", "please find"]
    assert column(spark, asked, T.cleaned_query) == [global_search.cleaned(a) for a in asked] == ["wid", "config", "of", "please find"]


def test_suggestions(spark):
    assert column(spark, ["a b", "my database works well"], T.suggested_keywords) == [K.DEFAULT_HINT, "db data function method well"]
    assert column(spark, ["class config", "yaml how", "guide", "x"], T.suggested_type) == ["code", "config", "docs", "all"]


def test_previews_and_counts(spark):
    long, exact = "é" * 201, "x" * 200
    assert column(spark, [long, exact, None], T.preview) == ["é" * 200 + "...", exact, None]
    assert column(spark, [exact], T.dotted_preview) == [exact + "..."]
    assert column(spark, ["aaaa", "b"], lambda x: T.occurrences(x, F.lit("aa"))) == [2, 0]
    assert column(spark, ["abcdefg", "é😀"], T.token_estimate) == [1, 0]
    assert column(spark, [" a\tb\n c ", ""], T.word_count) == [3, 0]


def test_paths(spark):
    paths = ["a/b.tar.GZ", ".env", "x/.hidden.md", "Makefile", "a.b/c", "end."]
    assert column(spark, paths, T.suffix) == [".gz", "", ".md", "", "", ""]
    assert column(spark, paths, T.stem) == ["b.tar", ".env", ".hidden", "Makefile", "c", "end."]


def test_markdown_and_space(spark):
    assert column(spark, ["![i](u) [t](v) `c` <b>x</b>\n```\nz\n```\n\n \n\ny  w "], T.clean_markdown) == ["t x\n\ny w"]
    assert column(spark, ["a  b \n\n \n\nc "], T.normalized_space) == ["a b\n\nc"]


def test_comments(spark):
    df = spark.createDataFrame([("x = 1 # one\n#\n y", "python"), ("a // b\n/* c\n * d */", "java"), ("# no", "other")], "c string, l string")
    assert [r.y for r in df.select(T.comments("c", "l").alias("y")).collect()] == [["one"], ["b", "c\nd"], []]


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aé B.!?\t\n_1-", max_size=30), min_size=1, max_size=20))
def test_sentences_and_words_as_in_python(spark, texts):
    assert column(spark, texts, T.sentences) == [[s.strip() for s in re.split("[.!?]+", t) if s.strip()] for t in texts]
    assert column(spark, texts, T.words) == [[w for w in re.split(r"[^\w]+", t.lower()) if w] for t in texts]


@pytest.mark.parametrize(("mean", "label"), [(0.9, "healthy"), (0.79, "warning"), (0.1, "warning")])
def test_health(spark, mean, label):
    assert column(spark, [mean], T.health_label, "double") == [label]
