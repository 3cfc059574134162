import random

from groundwork.llm import pieces

SCHEMA = "id string, pages array<struct<page_number:int,text:string>>, piece_no int, text string"
LIMITS = [("scope", 300, 30), ("page", 100, 10)]


def limits(spark, rows=LIMITS):
    return spark.createDataFrame(rows, "item_kind string, max_chars int, overlap_chars int")


def text(rng, n):
    return "".join(rng.choice(["word ", "end. ", "x", "\n", "\n\n", "Größe ", "水门。", "👩‍🔬", "é"]) for _ in range(n))


def test_greedy_by_brute_force():
    rng = random.Random(5)
    for _ in range(120):
        t, limit = text(rng, rng.randint(1, 200)), rng.randint(5, 90)
        overlap = rng.randint(0, limit - 1)
        levels = pieces.pauses(t, [])

        def after(start, cut):
            high = start + limit
            if high >= len(t):
                return len(t)
            low = max(start + limit // 2, cut)
            for level in levels:
                at = [int(p) for p in level if low < p <= high]
                if at:
                    return max(at)
            return high

        cuts, cut, start = [], 0, 0
        while True:
            cut = after(start, cut)
            cuts.append(cut)
            if cut >= len(t):
                break
            start = cut - overlap
        assert pieces.all_cuts([(t, [], limit, overlap)])[0].tolist() == cuts


def test_pieces_hold_the_limit_share_the_overlap_and_rejoin(spark):
    rng = random.Random(2)
    scopes = [(f"s{i}", [(k, text(rng, rng.randint(0, 60))) for k in range(1, 8)], 0, "clash") for i in range(20)]
    got = pieces.split_scopes(spark.createDataFrame(scopes, SCHEMA), limits(spark), only_oversized=False).collect()
    by = {}
    for r in sorted(got, key=lambda r: r.piece_no):
        by.setdefault((r.section_id, r.page_number), []).append(r)
    whole = {(s, 0): "".join(t for _, t in p) for s, p, *_ in scopes} | {(s, k): t for s, p, *_ in scopes for k, t in p}
    assert set(by) == set(whole)
    for key, rows in by.items():
        most, overlap = (300, 30) if key[1] == 0 else (100, 10)
        assert pieces.rejoined([(r.char_start, r.char_end, r.text) for r in rows]) == whole[key]
        assert all(len(r.text) <= most for r in rows)
        assert all(a.char_end - b.char_start == overlap for a, b in zip(rows, rows[1:]))


def test_found_and_odd_rows(spark):
    long = "a" * 150
    rows = [
        ("over", [(1, long), (2, long), (3, "b" * 10)], 1, ""),
        ("over", [(1, long), (2, long), (3, "b" * 10)], 1, ""),
        ("at", [(1, "c" * 100), (2, "d" * 100), (3, "e" * 100)], 1, ""),
        ("nulls", [(1, None), None, (None, "f" * 101)], 1, ""),
        ("null", None, 1, ""),
        ("empty", [], 1, ""),
        (None, [(1, long)], 1, ""),
    ]
    got = sorted(map(tuple, pieces.oversized(spark.createDataFrame(rows, SCHEMA), limits(spark)).collect()), key=str)
    assert got == sorted([("over", 0), ("over", 1), ("over", 2), ("nulls", None)], key=str)


def test_missing_limits_and_very_long_text(spark):
    df = spark.createDataFrame([("s", [(1, "z" * 1_000_000)], 0, "")], SCHEMA)
    assert pieces.oversized(df, limits(spark, [])).count() == 0
    assert pieces.split_scopes(df, limits(spark, [("page", 1000, 999)]), with_text=False).count() == 1_000_000 - 1000 + 1
    assert pieces.oversized(df.limit(0), limits(spark)).count() == 0
    tie = spark.createDataFrame([("s", [(1, "ab" * 10)], 0, "")], SCHEMA)
    assert pieces.split_scopes(tie, limits(spark, [("page", 10, 50)]), with_text=False).count() == 11


def test_many_limit_kinds_and_small_portions(spark, monkeypatch):
    monkeypatch.setattr(pieces, "TOGETHER", 200)
    rows = [(f"kind{i}", i, 0) for i in range(12)] + LIMITS
    scopes = spark.createDataFrame([(f"s{i}", [(1, "word " * 70)], 0, "") for i in range(5)], SCHEMA)
    got = {tuple(r) for r in pieces.oversized(scopes, limits(spark, rows)).collect()}
    assert got == {(f"s{i}", n) for i in range(5) for n in (0, 1)}
    assert pieces.portions([]) == [] and pieces.portions([150, 150, 30, 500]) == [slice(0, 1), slice(1, 3), slice(3, 4)]
