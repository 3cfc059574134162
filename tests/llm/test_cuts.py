from groundwork.llm import cuts

PAGE = "Notes on decay\n\nThe vat keeps its pressure for 5.5 mm. Dr. Vososabox asked, “Is it worn? It is.” The vein is open.\n\n- short-lived seam\n- damp loam\n\nThe lens settles…"
BLOCKS = "id string, raw_text string, provider string"


def found(spark, replies=(), concepts=(), blocks=()):
    r = spark.createDataFrame([(*x, 1) for x in replies], "id string, provider string, text string, n int")
    c = spark.createDataFrame([(*x, "clash") for x in concepts], "id string, provider string, source_excerpt string, source_block_id string, text string")
    b = spark.createDataFrame([(*x, "clash") for x in blocks], BLOCKS)
    return {x.record_id for x in cuts.cut_records(r, c, b).collect()}


def test_excerpts_by_their_page(spark):
    whole = ["The vat keeps its pressure for 5.5 mm.", "Notes on decay", "- damp loam", "The lens settles…", "asked, “Is it worn? It is.”", "The vein is open."]
    cut = ["The vat keeps its pres", "The vat keeps its pressure for 5.", "Dr.", "The vat keeps its […]", "asked, “Is it worn?", "- short-lived", "The vein is ope-", "The vein is", "Notes on"]
    concepts = [(f"w{i}", "p", e, "b") for i, e in enumerate(whole)] + [(f"c{i}", "p", e, "b") for i, e in enumerate(cut)] + [("n1", "p", None, "b"), ("n2", "p", "", "b"), ("n3", None, "  ", None), ("x", "p", "It goes on and", "gone"), ("c0", "p", cut[0], "b")]
    assert found(spark, concepts=concepts, blocks=[("b", PAGE), ("b", PAGE)]) == {f"c{i}" for i in range(len(cut))} | {"x"}


def test_replies(spark):
    whole = ['{"a": [1, "x}"]}', '```json\n{"a": 1}\n```', 'Here is the result:\n{"a": 1}', '{"a": 1}\n\nLet me know if more is needed.', "It is done.", "„Ist er zäh?“, fragte sie am Abend.", "Points:\n\n- dense keel\n- damp seam", "It is (see Fig. 5).", "Überschrift", "Notes on decay", "It was seen before [1] and (see [a]), so it holds:\n" + "It is so. " * 40 + '{"a": [1, 2]}', "[1, 2, 3]"]
    cut = ['{"a": [1, "x', '{"a": 1, "b": [', '```json\n{"a": "b"', '{"a": 1}\n\nLet me know if mo', "It is done. The next", "It is wor…", "It says “The vat is worn.", "Typical parts, e.g.", "broken �", "It was seen [1]. " * 30 + '{"a": [1, ', "[1, 2, ", "Points:\n\n- dense keel\n- damp"]
    rows = [(f"w{i}", "p", t) for i, t in enumerate(whole)] + [(f"c{i}", "p", t) for i, t in enumerate(cut)] + [("n", "p", None), ("e", "p", ""), ("c1", "p", cut[1])]
    assert found(spark, rows) == {f"c{i}" for i in range(len(cut))}


def test_a_length_with_many_ends_is_significant(spark):
    rows = [("concept", "p", 50 + i % 60) for i in range(240)] + [("concept", "p", 100)] * 60 + [("concept", "q", n) for n in range(40, 140)]
    df = spark.createDataFrame(rows, "record_kind string, provider string, n_chars int")
    got = {(r.provider, r.n_chars) for r in cuts.significant_lengths(df).collect()}
    assert got == {("p", 100)}


def test_a_significant_length_decides_on_list_items_of_replies(spark):
    filler = "The vat keeps its pressure. "
    rows = [(f"r{i:03}", "p", (filler * 12)[: 49 + i % 60].rsplit(" ", 1)[0] + "x" * (i % 3) + ".") for i in range(240)]
    item = "Typical parts:\n\n- dense dark keel\n- clay-rich old pla"
    rows += [(f"cut{i:02}", "p", "y" * (120 - len(item) - 2) + ".\n" + item) for i in range(60)]
    rows += [("closed", "p", "z" * 119 + "."), ("json", "p", '{"a": "' + "b" * 111 + '"}'), ("other", "p", "y" * 9 + ".\n" + item)]
    assert {len(t) for i, _, t in rows if i[:3] in ("cut", "clo", "jso")} == {120}
    assert found(spark, rows) == {f"cut{i:02}" for i in range(60)}


def test_rates_and_empty_tables(spark):
    r = spark.createDataFrame([("1", "p", "It is done."), ("2", "p", "It is"), ("3", None, None)], "id string, provider string, text string")
    c = spark.createDataFrame([], "id string, provider string, source_excerpt string, source_block_id string")
    b = spark.createDataFrame([], "id string, raw_text string")
    got = cuts.cut_rates(r, c, b).collect()
    assert [(x.record_kind, x.provider, x.n_records, x.n_cut, x.cut_rate) for x in got] == [("reply", "p", 2, 1, 0.5)]
    assert cuts.cut_records(r.limit(0), c, b).count() == 0


def test_poisson_tail():
    assert cuts.poisson_tail(0, 3.0) == 1.0
    assert abs(cuts.poisson_tail(1, 2.0) - (1 - 2.718281828459045**-2)) < 1e-12
    assert cuts.poisson_tail(60, 2.0) < 1e-50
