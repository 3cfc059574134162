from groundwork.llm import looks

BLOCKS = "id string, normalized_text string, look string"
CONCEPTS = "id string, source_excerpt string, source_block_id string, text string"
PAGE = "The naïve gasket keeps its pressure at 5 cm². Then „Größe“ fails."


def found(spark, blocks, concepts):
    b = spark.createDataFrame([(*r, "clash") for r in blocks], BLOCKS)
    c = spark.createDataFrame([(*r, "clash") for r in concepts], CONCEPTS)
    return {tuple(r) for r in looks.same_look(b, c).collect()}


def test_excerpts_that_only_look_alike(spark):
    same = ["nаïve gasket", "ｎａïｖｅ gasket", "naïve gas​ket", "naïve gasket", "na­ïve gaѕkеt", "Größe“ fаils"]
    other = ["Naïve gasket", "naive gasket", "5 cm2", "gaskets", "keeps  its"]
    concepts = [(f"con_{i}", e, "blk_1") for i, e in enumerate(same + other + ["naïve gasket", "", None, "​"])] + [("con_x", "nаïve gasket", None), ("con_y", "nаïve gasket", "blk_0")]
    got = found(spark, [("blk_1", PAGE), ("blk_1", PAGE), ("blk_2", None), ("blk_3", "")], concepts + concepts)
    assert got == {("blk_1", f"con_{i}") for i in range(len(same))}


def test_pages_of_one_look_and_copies(spark):
    blocks = [("b1", PAGE), ("b2", PAGE), ("b3", PAGE.replace("e", "е", 1)), ("b4", PAGE.upper()), ("b5", "​"), ("b6", "⁠"), ("b7", "ВОДА α β"), ("b8", "BOДA α β")]
    got = found(spark, blocks, [])
    assert got == {("b1", "b3"), ("b2", "b3"), ("b7", "b8")}


def test_look_alikes_need_the_vocabulary(spark):
    df = spark.createDataFrame([(1, "zеbrа crosses"), (2, "quаggа"), (3, "quaggа"), (4, "zebra"), (5, "ВОДА"), (6, None), (7, "")], "k int, t string")
    got = {r.k: r.look for r in looks.one_form(df, "k", "t").collect()}
    assert got == {1: "zebra crosses", 2: "quagga", 3: "quagga", 4: None, 5: None, 6: None, 7: None}
    alone = spark.createDataFrame([(1, "zеbrа")], "k int, t string")
    assert looks.one_form(alone, "k", "t").collect()[0].look is None


def test_one_form_is_stable_and_keeps_what_is_seen(spark):
    for t in ["x² 水，门", "👩‍🔬 works", "é É", "…", "ВОДА", "a" * 100_000 + "ﬁ", "ｋＰａ。"]:
        once = looks.plain(t)
        assert looks.plain(once) == once
    assert looks.plain("x² 👩‍🔬 水，门") == "x² 👩‍🔬 水，门"
    assert looks.plain("ｋＰａ ﬁrst a b") == "kPa first a b"


def test_empty_tables(spark):
    assert found(spark, [], []) == set()


def test_classes_of_looks(spark):
    blocks = [("b1", PAGE), ("b2", PAGE), ("b3", PAGE.replace("e", "е", 1)), ("b4", PAGE.upper()), ("b9", None)]
    b = spark.createDataFrame([(*r, "clash") for r in blocks], BLOCKS)
    got = {tuple(r) for r in looks.look_classes(b, spark.createDataFrame([], CONCEPTS)).collect()}
    assert got == {("b1", "b1", "b1", 2, 1), ("b2", "b1", "b1", 2, 1), ("b3", "b1", "b3", 2, 2)}
