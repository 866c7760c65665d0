"""Components against brute force, and how many tables they write."""

import numpy as np
import pytest

from linkloom.llm import components as stars
from linkloom.llm import jaccard_join
from linkloom.session import cut_lineage


def brute(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def table(spark, links):
    return spark.createDataFrame(links, "a long, b long")


def found(groups):
    rows = groups.collect()
    assert len({r["node"] for r in rows}) == len(rows)
    return {r["node"]: r["root"] for r in rows}


@pytest.fixture
def written(monkeypatch):
    tables = []

    def counted(df):
        tables.append(df.columns)
        return cut_lineage(df)

    monkeypatch.setattr(stars, "cut_lineage", counted)
    monkeypatch.setattr(jaccard_join, "cut_lineage", counted)
    return tables


@pytest.mark.parametrize("links", [[], [(3, 3)], [(1, 2), (2, 1), (1, 2)], [(k, k + 1) for k in range(9)], [(5, 9), (9, 1), (7, 9), (4, 6)]])
def test_components(spark, links):
    assert found(stars.components(table(spark, links))) == brute(links)


def test_later_links_join_groups(spark):
    rng = np.random.default_rng(3)
    old, new = ([tuple(map(int, x)) for x in rng.integers(60, size=(n, 2))] for n in (25, 20))
    # fresh nodes, one below a group's root, links within a group and of a node with itself
    new += [(100, 101), (-1, old[0][0]), old[1], (102, 102)]
    groups = cut_lineage(stars.components(table(spark, old)))
    assert found(stars.joined(groups, table(spark, new))) == brute(old + new)
    assert found(stars.joined(groups, table(spark, []))) == brute(old)


def test_stars_are_written_once(spark, written):
    stars.components(table(spark, [(2 * k, 2 * k + 1) for k in range(20)]))
    assert len(written) == 1


def test_rounds_without_links_write_no_groups(spark, written):
    texts = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(6)]
    given = spark.createDataFrame(list(enumerate([*texts, texts[0] + " more"])), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(given).collect()}
    assert got == {**{k: k for k in range(6)}, 6: 0}
    assert len(written) <= 16
