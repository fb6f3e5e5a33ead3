"""Connected components: the same groups as a plain union-find, hot keys dealt and only those, each link made once."""

import uuid

import pytest

from bindery.llm import _skew


def groups(links):
    up = {}

    def root(a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    for a, b in links:
        if a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {a: root(a) for a in list(up)}


CHAIN = [(i, i + 1) for i in range(100, 160)] + [(7, 7), (3, 160), (160, 3)]
STAR = [(5000, i) for i in range(1000, 1700)] + [(i, i + 10_000) for i in range(1000, 1010)]


@pytest.mark.parametrize("links, dealt", [([], False), (CHAIN[-9:], False), (CHAIN[-9:] + STAR, True)], ids=["none", "chain", "star"])
def test_components_deal_hot_keys_only(spark, monkeypatch, links, dealt):
    used, plain = [], _skew.dealt_join
    monkeypatch.setattr(_skew, "dealt_join", lambda *a, **b: used.append(1) or plain(*a, **b))
    found = {r.doc: r.comp for r in _skew.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == groups(links)
    assert bool(used) == dealt


def test_components_make_their_links_once(spark, tmp_path):
    made = str(tmp_path)

    def run(parts):
        for part in parts:
            open(f"{made}/{uuid.uuid4().hex}-{part.num_rows}", "w").close()
            yield part

    links = spark.createDataFrame(CHAIN, "a long, b long").coalesce(1).mapInArrow(run, "a long, b long")
    found = {r.doc: r.comp for r in _skew.components(links).collect()}
    assert found == groups(CHAIN)
    assert sum(int(p.name.rpartition("-")[2]) for p in tmp_path.iterdir()) == len(CHAIN)
