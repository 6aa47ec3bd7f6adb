"""Search for many texts at once against `in`, for both ways, and its cost on long texts."""

import random
import time

import pytest

from quartier.operators import admin, search


def cases():
    r = random.Random(5)
    word = lambda n: "".join(r.choices("abcđê ", k=n))
    texts = [(i, word(r.choice([0, 3, 40, 10_000 if i % 40 == 0 else 80]))) for i in range(120)] + [(500, None), (501, "ĐÊ  aB\tc"), (502, "")]
    needles = [word(r.randint(1, 6)) for _ in range(200)] + [None, "", "Đê", "zz", "a\tb", "Đê"]
    return texts, needles


@pytest.mark.parametrize("chars", [10**6, 0])
@pytest.mark.parametrize("tokens", [False, True])
def test_contained(spark, monkeypatch, chars, tokens):
    monkeypatch.setattr(search, "AUTOMATON_CHARS", chars)
    texts, needles = cases()
    plain = (lambda x: " ".join(x.lower().split())) if tokens else str.lower
    wanted = {plain(n) for n in needles if n} - {""}
    holds = (lambda t, n: f" {n} " in f" {t} ") if tokens else (lambda t, n: n in t)
    want = {(i, n) for i, t in texts if t for n in wanted if holds(plain(t), n)}
    got = search.contained(spark.createDataFrame(texts, "i int, t string"), spark.createDataFrame([(n,) for n in needles], "n string"), tokens=tokens).collect()
    assert len(got) == len(set(got)) and {tuple(x) for x in got} == want and len(want) > 100


def test_contains_join_of_repeated_and_short_needles(spark):
    left = spark.createDataFrame([("a", "Hà Nội cũ"), ("b", None), ("c", "hà")], "k string, t string")
    right = spark.createDataFrame([(1, "hà nội"), (2, "HÀ NỘI"), (3, "h"), (4, None), (5, "hà")], "id int, n string")
    got = sorted(tuple(x) for x in admin.contains_join(left, "t", right, "n", "k", "id").collect())
    assert got == [("a", 1), ("a", 2), ("a", 5), ("c", 5)]
    assert search.contained(left, spark.createDataFrame([], "n string")).collect() == []


def test_time_is_linear_in_the_text(spark):
    """100 times the text takes nothing like 10,000 times as long."""
    r = random.Random(1)
    needles = [(f"{r.randrange(10**6)}",) for _ in range(5000)]
    words = spark.sparkContext.broadcast([n for (n,) in needles])
    a = search._automaton(words)
    text = "".join(r.choices("0123456789 ", k=1_000_000))

    def took(n):
        at = time.perf_counter()
        for _ in range(3):
            search._hits(text[:n], a, False)
        return time.perf_counter() - at

    took(10_000)
    assert took(1_000_000) < 400 * max(took(10_000), 1e-4)
    spark_texts = spark.createDataFrame([(i, text[i * 10_000 : (i + 1) * 10_000]) for i in range(20)], "i int, t string")
    got = {tuple(x) for x in search.contained(spark_texts, spark.createDataFrame(needles, "n string")).collect()}
    assert got == {(i, n) for i in range(20) for (n,) in needles if n in text[i * 10_000 : (i + 1) * 10_000]}
