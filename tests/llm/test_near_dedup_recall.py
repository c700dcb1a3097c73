"""Recall of near-dedup at given similarities, where third texts share a template with every pair, and by the covering tables alone."""

import random

import pytest

from tessera.llm import simhash

PAIRS = 150


def shingle_set(text):
    w = text.split(" ")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def similarity(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b)


def near_copy(rng, text, goal, fresh):
    """The text with runs of its words replaced until its similarity would fall under `goal`."""
    w = text.split(" ")
    while True:
        at, n = rng.randrange(len(w) - 8), rng.randint(1, 2)
        new = w[:at] + [fresh() for _ in range(n)] + w[at + n :]
        if similarity(text, " ".join(new)) < goal:
            return " ".join(w)
        w = new


@pytest.fixture(scope="module")
def corpus():
    """Pairs at 0.80, 0.85 and 0.90, and strangers, all with half of their words from one template: the least hashes of any two are often the same."""
    rng = random.Random(17)
    word = iter(range(10**9))
    fresh = lambda: f"w{next(word)}"
    template = [fresh() for _ in range(160)]
    own = lambda: " ".join([*template, *[fresh() for _ in range(rng.randint(100, 200))]])
    rows, pairs = [], {}
    for goal in (0.80, 0.85, 0.90):
        for _ in range(PAIRS):
            a = own()
            b = near_copy(rng, a, goal, fresh)
            assert goal <= similarity(a, b) < goal + 0.04
            pairs.setdefault(goal, []).append((len(rows), len(rows) + 1))
            rows += [a, b]
    rows += [own() for _ in range(600)]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return [(ids[i], t) for i, t in enumerate(rows)], {g: [(ids[a], ids[b]) for a, b in p] for g, p in pairs.items()}


@pytest.mark.parametrize("tables_alone", [False, True])
def test_recall(spark, corpus, monkeypatch, tables_alone):
    rows, pairs = corpus
    if tables_alone:
        monkeypatch.setattr(simhash, "word_prints", lambda docs, f=simhash.word_prints: f(docs).withColumns({m: simhash.F.lit(None).cast("long") for m in simhash.M_NAMES}))
    keeper = {r["doc_id"]: r["keeper"] for r in simhash.copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {g: sum(keeper.get(max(p)) == min(p) for p in some) / PAIRS for g, some in pairs.items()}
    print(tables_alone, found)
    assert all(x >= 0.9 for x in found.values()), found
    paired = {i for some in pairs.values() for p in some for i in p}
    assert not set(keeper) - paired  # strangers share half of their words: no copies
