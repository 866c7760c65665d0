"""Keyword lookups by the runs that a bitmap has."""

import random

import pyarrow as pa
import pytest

from linkloom.functions import runs as R
from linkloom.operators import lookups as K
from linkloom.session import cut_lineage


@pytest.mark.parametrize("size", [5, 1 << 16])
def test_runs_met_are_those_of_the_texts(spark, monkeypatch, size):
    monkeypatch.setattr(R, "SLICE", size)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abé/") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts[3:5] = [None, ""]
    held = sorted({t[i : i + n] for t in texts[::9] if t for n in (1, 2, 3, 6, 8, 9, 17, 24) for i in [len(t) // 3] if i + n <= len(t)})
    codes = dict(zip(held, R.whole_codes(pa.array(held)).to_pylist(), strict=True))
    assert len(set(codes.values())) == len(held)
    index = cut_lineage(R.with_code(spark.createDataFrame([(h,) for h in held], "run string"), "run", "code"))
    assert {r["run"]: r["code"] for r in index.collect()} == codes
    sizes = sorted({len(h.encode()) for h in held})
    met = R.runs_met(pa.array(["ab", *texts]).slice(1), sizes, R.bitmap(index, "code")).to_pylist()
    own = set(codes.values())
    for text, got in zip(texts, met, strict=True):
        assert len(got) == len(set(got)) and own & set(got) == {c for h, c in codes.items() if text and h in text}, text
    # others pass by chance alone
    assert sum(len(set(got) - own) for got in met) < 20
    assert R.runs_met(pa.array([], pa.string()), sizes, R.bitmap(index, "code")).to_pylist() == []


def test_runs_without_a_keyword_are_never_rows(spark):
    """Before, a text gave a row for each of its runs, and those were shuffled to an index of some size."""
    texts = spark.createDataFrame([(f"http://h{i}.example.com/some/longer/path/{i}",) for i in range(500)], "url string")
    keywords = spark.createDataFrame([("/17",), ("qqq",), ("h4.",)], "keyword string")
    index, runs = K._run_lookup(texts, K.gram_index(keywords, "keyword"), "url")
    met = sum(len(r[0]) for r in texts.select(runs).collect())
    assert 12 <= met < 30
    got = K.keyword_matches(texts, keywords, "url").collect()
    assert sorted((r["url"], r["keyword"]) for r in got) == sorted(
        (r["url"], k) for r in texts.collect() for k in ("/17", "qqq", "h4.") if k in r["url"]
    )


def test_keyword_semi_join_keeps_repeats_and_columns(spark):
    links = spark.createDataFrame([(1, "x1"), (1, "x1"), (2, "yé"), (3, None), (4, "")], "n int, url string")
    words = lambda *w: spark.createDataFrame([(x,) for x in w], "keyword string")
    kept = lambda *w: sorted((r["n"] for r in K.keyword_semi_join(links, words(*w), "url").collect()))
    assert kept("x", "é", "x") == [1, 1, 2] and kept("", "zz") == [1, 1, 2, 4]
    assert kept(None) == [] and kept("é", None) == [2] and kept("zzz") == []
    assert all(K.keyword_semi_join(links, words(w), "url").columns == ["url", "n"] for w in ("x", "", None))
