import random

from groundwork.llm import scans

SCHEMA = "id string, document_version_id string, page_index int, raw_text string, text_source string, word string"
NATIVE = "the low-lying vat keeps its pressure and the well-drained saturation of each modern reservoir between seasons . Pre- and post-season checks of the orchard differ ."


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_trie_and_automaton_find_every_word_within_reach():
    rng = random.Random(6)
    words = {"".join(rng.choice("abcr") for _ in range(rng.randint(1, 6))) for _ in range(300)}
    trie = scans.make_trie(sorted(words))
    for _ in range(80):
        q = "".join(rng.choice("abcr") for _ in range(rng.randint(1, 6)))
        for errors in (1, 2):
            assert set(scans.within(trie, q, errors)) == {w for w in words if distance(q, w) <= errors}
    trie = scans.make_trie(["modern", "tidal", "warm", "follows", "pressure"])
    for read, meant in (("modem", "modern"), ("ticlal", "tidal"), ("warrn", "warm"), ("follovvs", "follows"), ("pressiire", "pressure")):
        assert meant in scans.within(trie, read, 1)


def found(spark, blocks):
    return {tuple(r) for r in scans.scan_noise(spark.createDataFrame([(*b, "clash") for b in blocks], SCHEMA)).collect()}


def pages():
    native = [(f"n{i}", "v0", i, NATIVE, "native") for i in range(60)]
    one = "CARE OF THE VAT\n\nThe low-\nlying vat keeps its pres¬\nsure. Pre- and post-\nseason checks, pre-\nand post-season, differ.\n11"
    two = "Care of the vat  12\n\nThe sa-\nturation of e4ch modcrn reservo1r\nbetween seasons: 42\n\nThe vat."
    return native, [("s1", "v1", 1, one, "ocr"), ("s2", "v1", 2, two, "ocr")]


def test_noise_by_line(spark):
    native, scanned = pages()
    odd = [("s3", "v2", 1, None, "ocr"), ("s4", "v2", 2, "", "ocr"), ("s1", *scanned[0][1:])]
    want = {("s1", 1, "running_header"), ("s1", 3, "split_compound"), ("s1", 4, "split_word"), ("s1", 5, "split_compound"), ("s1", 8, "page_number"), ("s2", 1, "running_header"), ("s2", 3, "split_word"), ("s2", 4, "misread")}
    assert found(spark, native + scanned + odd) == want


def test_repair(spark):
    native, scanned = pages()
    df = spark.createDataFrame([(*b, "") for b in native + scanned], SCHEMA)
    got = {r.block_id: r.text for r in scans.repaired_pages(df).collect()}
    assert got["s1"] == "The low-lying vat keeps its pressure. Pre- and post-season checks, pre- and post-season, differ."
    assert got["s2"] == "The saturation of each modern reservoir between seasons: 42\n\nThe vat."


def test_split_and_misread_words_are_put_right(spark):
    native = [(f"n{i}", "v0", i, "the normal condition of l'enzyme is stable in the low-lying vat", "native") for i in range(60)]
    text = "Head\nxii\nThe normal condi-\ntlon ls stable. The low-\nlying vat of l'enzyrne.[74]"
    df = spark.createDataFrame([(*b, "") for b in [*native, ("s", "v", 1, text, "ocr"), ("t", "v", 2, "Head\n\nThe vat", "ocr")]], SCHEMA)
    assert {r.block_id: r.text for r in scans.repaired_pages(df).collect()} == {"s": "The normal condition is stable. The low-lying vat of l'enzyme.[74]", "t": "The vat"}
    got = {tuple(r) for r in scans.scan_noise(df).collect()}
    assert got == {("s", 1, "running_header"), ("t", 1, "running_header"), ("s", 2, "page_number"), ("s", 3, "split_word"), ("s", 4, "misread"), ("s", 4, "split_compound"), ("s", 5, "misread")}


def test_nothing_to_read(spark):
    assert found(spark, []) == set()
    assert found(spark, [("n", "v", 1, NATIVE, "native")]) == set()
    assert found(spark, [("s", None, None, "plain words here " * 20_000, "ocr")]) == set()
