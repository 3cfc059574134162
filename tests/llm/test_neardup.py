import random
import re

from groundwork.llm import neardup
from groundwork.llm.queries import QUERIES


def brute(rows, threshold=0.85):
    sets = {i: set(re.findall(r"[^\W_]+", t.lower())) for i, t in dict(rows).items() if t}
    ids = sorted(i for i, s in sets.items() if s)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 2 * len(sets[a] & sets[b]) / (len(sets[a]) + len(sets[b])) > threshold}


def corpus(n=150, seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        base = ["the", "of", "and"] + rng.sample(words, rng.randint(4, 25))
        rows.append((f"c{i:04}", " ".join(base)))
        for k in range(rng.choice([0, 0, 1, 3])):
            changed = [w for w in base if rng.random() > 0.07] + rng.sample(words, rng.randint(0, 2))
            rng.shuffle(changed)
            rows.append((f"c{i:04}{k}", " ".join(changed).upper()))
    return rows


def cards(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "id string, claim string, words string")


def test_pairs_by_brute_force(spark):
    rows = corpus()
    got = [tuple(r) for r in neardup.near_copies(cards(spark, rows + rows[:9])).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_groups_by_brute_force(spark):
    rows = corpus(80, 9)
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute(rows):
        parent[root(a)] = root(b)
    got = {r.card_id: (r.group_id, r.group_size) for r in neardup.near_copy_groups(cards(spark, rows)).collect()}
    want = {}
    for i in parent:
        want.setdefault(root(i), set()).add(i)
    mine = {}
    for i, (g, n) in got.items():
        mine.setdefault(g, set()).add(i)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, mine.values()))
    assert all(got[i][1] == len(s) for s in mine.values() for i in s)


def test_a_chain_is_one_component(spark):
    edges = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(40)] + [("z1", "z2"), ("z2", "z1")], "a string, b string")
    got = {r.node: r.group for r in neardup.components(edges).collect()}
    assert set(got.values()) == {"n000", "z1"} and len(got) == 43


def test_hot_nodes_are_joined_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 3)
    rows = corpus(30, 2) + [(f"h{i:03}", f"one two three four five six seven eight nine ten eleven twelve x{i}") for i in range(25)]
    assert {tuple(r) for r in neardup.near_copies(cards(spark, rows)).collect()} == brute(rows)


def hot_class():
    rows = [(f"h{i:02}", "One two three four five six seven.") for i in range(9)]
    rows += [(f"m{i:02}", ["Seven six five four three two one!", "two one three four five six seven"][i % 2]) for i in range(7)]
    return rows + [("x", "one two three four five six seven eight"), ("y", "one two three four five six seven nine")]


def test_every_pair_of_a_hot_class(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rows = hot_class()
    cards(spark, rows).write.parquet(f"{tmp_path}/cards.parquet")
    got = [tuple(r) for r in QUERIES["p5_found"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_classes_of_a_hot_class(spark):
    got = [tuple(r) for r in neardup.near_copy_classes(cards(spark, hot_class())).collect()]
    assert sorted(got) == [("h00", "x"), ("h00", "y"), ("x", "y")]


def test_recall_is_estimated_and_met_by_shortening(spark, monkeypatch):
    monkeypatch.setattr(neardup, "NODE", 1)
    monkeypatch.setattr(neardup, "TREES", 4)
    rows = corpus(200, 7)
    forest = neardup.Forest(neardup.claims(cards(spark, rows)), 0.85, target=0.99)
    found = {tuple(r) for r in forest.card_pairs().collect()}
    assert forest.recall >= 0.99 and len(found & brute(rows)) >= 0.97 * len(brute(rows)) and found <= brute(rows)
    assert neardup.estimated_recall(0, 0, 0) == 1.0 and neardup.estimated_recall(90, 10, 4) == 90 / 99


def test_a_closed_node_is_no_larger_than_its_rare_word_allows():
    import numpy as np

    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 400, 12)) for _ in range(500)]
    flat, n = np.unique(np.concatenate(sets), return_counts=True)
    counts = [n[np.searchsorted(flat, s)] for s in sets]
    for tree in range(4):
        key, closed = neardup.prefixes(sets, counts, 500, tree, 14, 6)
        nodes, sizes = np.unique(key[closed], return_counts=True)
        assert closed.any() and sizes.max() <= 14
        assert not set(nodes) & set(key[~closed])


def test_nulls_and_empty_table(spark):
    rows = [("a", None), ("b", ""), ("c", "!?"), (None, "one two"), ("d", "one two"), ("e", "word " * 50_000)]
    assert neardup.near_copies(cards(spark, rows)).count() == 0
    assert {r.card_id for r in neardup.near_copy_groups(cards(spark, rows)).collect()} == {"d", "e"}
    assert neardup.near_copies(cards(spark, [])).count() == 0
