import random

import pytest
from pyspark.sql import functions as F

from groundwork import functions as fn
from groundwork import plans
from groundwork.operators import cards, checks, coverage, documents, evaluation, greedy, grounding, ingest, inventory, pages, replies, reviews, similarity, study, support, trees
from groundwork.streaming import daily_counts

EVENT = "seq long, id string, user_id string, card_id string, mode string, schedule_modified int, rating int, reviewed_at string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def events(spark, rows):
    return spark.createDataFrame([(i, r[0], "u", r[1], "normal", r[2], r[3], r[4]) for i, r in enumerate(rows)], EVENT)


def ratings(*marks):
    return [(f"e{i}", "c", 1, m, f"2026-01-{i + 1:02}T10:00:00.000Z") for i, m in enumerate(marks)]


@pytest.mark.parametrize("marks, want", [((4,), (1, 1, 2.5)), ((4, 4), (2, 6, 2.5)), ((4, 4, 4), (3, 15, 2.5)), ((4, 4, 4, 1), (0, 1, 1.96)), ((0, 0, 0), (0, 1, 1.3)), ((5,), (1, 1, 2.6))])
def test_replay(spark, marks, want):
    r = reviews.replay(events(spark, ratings(*marks))).first()
    assert (r.repetition, r.interval_days, r.ease_factor) == want


def test_replay_order_redelivery_and_nulls(spark):
    rows = ratings(4, 4)[::-1] + [("e0", "c", 1, 4, "2026-01-09T10:00:00Z"), ("n", "c", 1, None, "2026-01-03T10:00:00Z"), ("cram", "c", 0, 1, "2026-01-04T10:00:00Z"), ("t", "c", 1, 1, "no time"), (None, "c", 1, 1, "2026-01-05T10:00:00Z")]
    r = reviews.replay(events(spark, rows)).first()
    assert (r.repetition, r.interval_days) == (2, 6)
    assert reviews.replay(events(spark, [("x", "c", 0, 1, None)])).count() == 0


def test_days_are_half_open_and_in_utc(spark):
    rows = [("a", "c", 1, 3, "2026-01-01T23:59:59.999Z"), ("b", "c", 1, 3, "2026-01-02T00:00:00.000Z"), ("d", "k", 1, 3, "2026-01-02T01:00:00+02:00"), ("x", "gone", 1, 3, "2026-01-02T01:00:00Z")]
    known = spark.createDataFrame([("c",), ("k",), ("k",), (None,)], "id string")
    got = {r.day: (r.reviews, r.new_cards) for r in reviews.daily_activity(events(spark, rows), known).collect()}
    assert got == {20454: (2, 2), 20455: (1, 0)}


@pytest.mark.parametrize("k, n, want", [(0, 0, (0.0, 1.0)), (196, 200, (0.9497, 0.9922)), (5, 5, (0.5655, 1.0)), (500, 500, (0.9924, 1.0))])
def test_wilson(spark, k, n, want):
    low, high = coverage.wilson(F.lit(k), F.lit(n))
    r = spark.range(1).select(low.alias("low"), high.alias("high")).first()
    assert (r.low, r.high) == pytest.approx(want, abs=2e-4)


def test_text_functions(spark):
    assert one(spark, fn.collapse(F.lit(" a \n b c　"))) == "a b c"
    assert one(spark, fn.content_words(F.lit("The cell. Cell-wall, of 3.5 µm"))) == ["the", "cell.", "cell-wall", "3.5"]
    assert one(spark, fn.quantities(F.lit("up 50% of 5 mV and -70,5 mV"))) == ["5:mv", "-70.5:mv"]
    assert one(spark, fn.has_words(F.lit("énot"), fn.NEGATION)) and not one(spark, fn.has_words(F.lit("knot"), fn.NEGATION))
    assert one(spark, fn.cloze_deletions(F.lit("{{c1::a::hint}} b {{c2::c}}"))) == ["a", "c"]
    assert one(spark, fn.cloze_as_claim(F.lit("{{c1::a::hint}} b {{c2::c}}"))) == "a b c"
    assert one(spark, fn.half_up(F.lit(1.005), 2)) == 1.0
    assert [one(spark, fn.word_count(F.lit(t))) for t in ("", " ", "a  b", None)] == [0, 0, 2, 0]


def test_similar_pairs_by_brute_force(spark):
    rng = random.Random(3)
    rows = [(f"i{n:03}", sorted(rng.sample("abcdefghijklmnopqrst", rng.randint(1, 18)))) for n in range(150)] + [("z1", None), ("z2", []), ("z3", ["a"]), ("z4", ["a", "a"])]
    df = spark.createDataFrame(rows, "id string, words array<string>")
    got = {(r.id_a, r.id_b) for r in similarity.similar_pairs(df.where("words is not null"), F.col("words")).collect()}
    want = {(a, b) for a, x in rows for b, y in rows if a < b and x and y and 2 * len(set(x) & set(y)) / (len(set(x)) + len(set(y))) > 0.85}
    assert got == want


def dice_pairs(rows, threshold=0.85):
    return {(a, b) for a, g, x in rows for b, h, y in rows if a < b and g == h and x and y and 2 * len(set(x) & set(y)) > threshold * (len(set(x)) + len(set(y)))}


@pytest.mark.parametrize("common", [1, 20, 200_000])
def test_similar_pairs_within_groups_whatever_counts_are_known(spark, monkeypatch, common):
    monkeypatch.setattr(similarity, "COMMON", common)
    rng = random.Random(5)
    rows = [(f"i{n:03}", rng.choice(["g", "h", None]), rng.sample("abcdefghijklmnopqrst", rng.randint(8, 19))) for n in range(200)]
    df = spark.createDataFrame(rows, "id string, g string, words array<string>")
    assert {(r.id_a, r.id_b) for r in similarity.similar_pairs(df, F.col("words"), split=F.col("g")).collect()} == dice_pairs(rows)


def shuffled_rows(spark):
    """Rows written for shuffles by all stages of the session so far."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_similar_pairs_of_one_template_are_sifted_before_they_are_shuffled(spark):
    # seven own words and one that only the template has are among the rarest eight of 29, so all texts of it meet
    rows = [(f"t{n:04}", [f"w{k}" for k in range(22)] + [f"{n - n % 20 if k < 5 else n}.{k}" for k in range(7)]) for n in range(1000)]
    df = spark.createDataFrame(rows, "id string, words array<string>")
    before = shuffled_rows(spark)
    got = {(r.id_a, r.id_b) for r in similarity.similar_pairs(df, F.col("words")).collect()}
    assert got == {(f"t{a:04}", f"t{b:04}") for a in range(1000) for b in range(a + 1, a - a % 20 + 20)}
    assert shuffled_rows(spark) - before < 200 * len(rows)


def test_first_statements_compare_with_kept_rows_only(spark):
    rows = [("a", "g", 1, list("abcdefghij")), ("b", "g", 2, list("abcdefghik")), ("c", "g", 3, list("abcdefghlk")), ("d", "h", 1, list("abcdefghij")), ("e", "g", 4, None)]
    df = spark.createDataFrame(rows, "id string, g string, n int, words array<string>")
    got = {r.id: r.kept_id for r in similarity.first_statements(df, "g", "n").collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e"}


def test_first_concepts_by_label_kind_and_decision(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [
        ("a", "left vat", "causal", "included_central", text),
        ("b", "Left  VAT!", "quantity", "included_eligible", "of quite another wording"),  # like label
        ("c", "keel", "quantity", "included_eligible", text),  # like excerpt of another kind
        ("d", "seam", "causal", "included_eligible", text),  # like excerpt of the same kind
        ("e", "left vat", "causal", "excluded_out_of_scope", text),  # passes
        ("f", "lens", "causal", "excluded_not_in_source", "the lens is worn by the tide"),
        ("g", "lens", "causal", "included_eligible", "the lens is worn by the tide"),  # f has nothing dropped
        ("h", "lens", "causal", "excluded_duplicate", "x"),
        ("i", "weir", "causal", "excluded_no_grounded_card", "it is so"),
        ("j", "weir", "causal", "included_eligible", "it is so"),
        ("k", None, None, None, None),
    ]
    df = spark.createDataFrame([(i, "j", n, *r) for n, (i, *r) in enumerate(rows)], "id string, job_id string, ordinal int, label string, kind string, decision string, source_excerpt string")
    got = {r.concept_id: r.kept_id for r in plans.first_concepts(df).collect()}
    assert got == {i: {"b": "a", "d": "a", "h": "g"}.get(i, i) for i, *_ in rows}


def test_grounding(spark):
    blocks = spark.createDataFrame([("b", "v", 1, 1, "the  vat is worn", "the vat is worn"), ("b2", "v", 2, 1, "", None), ("b3", "v", 3, 1, "x", "the lens settles")], "id string, document_version_id string, page_index int, ordinal int, raw_text string, normalized_text string")
    scopes = spark.createDataFrame([("s", "v", 1, 3)], "id string, document_version_id string, page_start int, page_end int")
    rows = [("in", "vat  is worn", "b", "s", 1), ("short", "vat", "b", "s", 1), ("lost", "lens settles", "b", "s", 1), ("gone", "lens settles", "q", "s", 9), ("none", None, "b", "s", 1), ("nowhere", "something else", "b", "s", 2)]
    c = spark.createDataFrame(rows, "id string, source_excerpt string, source_block_id string, section_id string, page_index int")
    got = {r.concept_id: (r.verdict, r.span_start) for r in grounding.cited_page(c, blocks).collect()}
    assert got == {"in": ("in_block", 4), "short": ("too_short", None), "lost": ("not_in_block", None), "gone": ("block_missing", None), "none": ("no_excerpt", None), "nowhere": ("not_in_block", None)}
    assert {(r.concept_id, r.page_index) for r in grounding.repaired_page(c, scopes, blocks).collect()} == {("lost", 3), ("gone", 3)}
    c = c.unionByName(spark.createDataFrame([("far", "vat is worn", "b", "unknown", 1)], c.schema))
    assert {(r.concept_id, r.code) for r in grounding.violations(c, scopes, blocks).collect()} == {("lost", "excerpt_not_on_page"), ("nowhere", "excerpt_not_on_page"), ("gone", "page_missing"), ("far", "page_missing")}
    assert {tuple(r) for r in grounding.located(c, scopes, blocks).collect()} == {("in", "b", 4, 15), ("short", "b", 4, 7)}
    decided = {r.concept_id: (r.decision, r.page_index) for r in inventory.decisions(c.selectExpr("*", "'x' label", "0.5D centrality"), scopes, blocks).collect()}
    assert decided == {"in": ("included_eligible", 1), "short": ("excluded_not_in_source", 1), "lost": ("included_eligible", 3), "gone": ("included_eligible", 3), "none": ("excluded_not_in_source", 1), "nowhere": ("excluded_not_in_source", 2), "far": ("excluded_out_of_scope", 1)}


def test_pages_and_packing(spark):
    s = spark.createDataFrame([("s", "v", [(2, "b" * 40), (1, "a" * 40), (3, None), (4, "c" * 300)]), ("n", "v", None), ("e", "v", [])], "id string, document_version_id string, pages array<struct<page_number:int,text:string>>")
    assert sorted((r.page_number, r.batch) for r in pages.pack(s, 80).collect()) == [(1, 0), (2, 0), (3, 0), (4, 1)]
    assert {r.section_id: (r.pages, r.n_words) for r in pages.scope_words(s).collect()} == {"s": (4, 3), "n": (0, 0), "e": (0, 0)}
    d = spark.createDataFrame([(1, "a b\n\n\n c \n\n  \n\nd"), (2, None), (3, "")], "doc_id long, text string")
    assert [(r.doc_id, r.paragraph_no, r.n_words) for r in pages.paragraphs(d).orderBy("doc_id", "paragraph_no").collect()] == [(1, 1, 2), (1, 2, 1), (1, 3, 1)]


def test_formats_replies_cards_checks_and_trees(spark):
    r = spark.createDataFrame([("1", "a.PDF ", "pdf"), ("2", "b.zip", "zip"), ("3", ".txt", "text")], "document_version_id string, file_name string, format string")
    assert {x.document_version_id: (x.detected, x.refused, x.agrees) for x in documents.formats(r).collect()} == {"1": ("pdf", None, True), "2": (None, "other container", False), "3": (None, None, False)}
    reply = spark.createDataFrame([("1", "concepts", 'Here:\n```json\n{"concepts":[{"label":"x","kind":"causal","centrality":7,"pageNumber":1,"sourceExcerpt":"e"},{"label":"y","kind":"causal","pageNumber":1,"sourceExcerpt":"e"},{"label":"z","kind":"other","centrality":1,"pageNumber":1,"sourceExcerpt":"e"}]}\n```'), ("2", "concepts", "no"), ("3", "concepts", None)], "id string, phase string, text string")
    assert [(x.reply_id, x.position, x.label, x.centrality) for x in replies.concept_rows(reply).collect()] == [("1", 0, "x", 1.0)]
    card = spark.createDataFrame([("k", "d", "s", "cloze", None, None, "{{c2::a}} {{c1::b}} {{c2::c}}", '["a"]', "x\ty\nz", '["a b"]', "a b c", None)], "id string, deck_id string, section_id string, format string, question string, answer string, cloze_text string, cloze_deletions string, explanation string, tags string, claim string, concept_id string")
    assert sorted((x.ord, x.note_id - 1_750_000_000_000, x.row_id - 1_750_000_000_000, x.tag_cell) for x in cards.export_cards(card).collect()) == [(0, 1, 2, " a_b "), (1, 1, 3, " a_b ")]
    concept = spark.createDataFrame([("g", "an\texcerpt", 4, "Part")], "id string, source_excerpt string, page_index int, section_title string")
    lines = {x.position: x.line for x in cards.export_lines(card.withColumn("concept_id", F.lit("g")), concept).collect()}
    assert lines[1] == "{{c2::a}} {{c1::b}} {{c2::c}}\t<small><i>Note: x    y<br>z</i></small>\t<blockquote>an    excerpt</blockquote>\tPage 4 (Part)\ta_b" and lines[-2] == "#deck:d" and len(lines) == 6
    assert cards.claims(card).first().as_stored
    edges = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "node string, parent string")
    assert {x.ancestor: (x.below, x.height) for x in trees.sizes(edges).collect()} == {"a": (2, 2), "b": (1, 1), "c": (0, 0)}
    assert {x.check: x.n for x in checks.tally({"o": checks.orphans(edges, "parent", edges, "node"), "r": checks.repeated(edges, "node"), "x": checks.outside(edges, "node", ["a"])}).collect()} == {"o": 0, "r": 0, "x": 2}


def test_deep_trees_and_own_pages(spark):
    chain = spark.createDataFrame([(f"n{i:03}", f"n{i - 1:03}" if i else None) for i in range(151)], "node string, parent string")
    assert {x.ancestor: x.below for x in trees.sizes(chain).collect()}["n000"] == 150
    rows = [("a", None, 1, 6), ("b", "a", 2, 3), ("c", "b", 3, 3), ("d", None, 7, 7), ("e", "d", 7, 7)]
    s = spark.createDataFrame(rows, "id string, parent_id string, page_start int, page_end int")
    got = {}
    for r in trees.own_pages(s).collect():
        got.setdefault(r.id, set()).add(r.page)
    assert got == {"a": {1, 4, 5, 6}, "b": {2}, "c": {3}, "e": {7}}
    some = spark.createDataFrame([("b",), (None,)], "id string")
    assert {r.id for r in trees.selected_sections(s, some).collect()} == {"b", "c"}
    assert {r.id for r in trees.selected_sections(s, some.limit(0)).collect()} == set("abcde")


def test_greedy_choice_by_brute_force(spark):
    rng = random.Random(8)
    edges = {(a, b) for a, b in (sorted(rng.sample(range(60), 2)) for _ in range(150))}
    dropped: dict[int, int] = {}
    for n in range(60):
        to = [a for a, b in edges if b == n and a not in dropped]
        if to:
            dropped[n] = min(to)
    got = greedy.first_kept(spark.createDataFrame([(a, b, a) for a, b in edges], "first int, later int, rank int"))
    assert {r.later: r["first"] for r in got.collect()} == dropped


PAGE = "Cells rest at -70 mV. The vat may leak at high temperatures. It holds 5 litres of salt water. The seal is not worn."


@pytest.mark.parametrize("claim, excerpt, want", [
    ("", "The vat may leak", ("contradicted", "claim_empty")),
    ("The vat leaks", "not on the page", ("contradicted", "citation_not_in_source")),
    ("It holds 6 litres of salt water", "It holds 5 litres", ("contradicted", "quantity_mismatch")),
    ("It holds 5.0 litres of salt water", "It holds 5 litres", ("inconclusive", "")),
    ("Cells of the vat rest at 5 litres", "Cells rest", ("inconclusive", "quantity_outside_citation")),
    ("The seal is worn.", "The seal is not worn.", ("contradicted", "negation_mismatch")),
    ("The vat always leak at high temperatures.", "The vat may leak at high temperatures.", ("inconclusive", "modality_overstated")),
    ("The vat may leak", "The vat may leak at high temperatures.", ("inconclusive", "condition_dropped")),
    ("Glaciers carve granite valleys where ochre lichens bloom", "It holds 5 litres", ("inconclusive", "term_not_in_source")),
])
def test_claim_support(spark, claim, excerpt, want):
    r = support.assess(spark.createDataFrame([("x", claim, excerpt, PAGE)], "id string, claim string, excerpt string, page string")).first()
    assert (r.verdict, r.codes) == want
    assert r.resolved == (excerpt in PAGE) and r.span_start == (PAGE.find(excerpt) if r.resolved else None)


def test_citation_context_and_judges(spark):
    rows = [("a", "It holds salt water", "holds 5 litres", PAGE), ("b", "", "x", PAGE), ("c", "It holds salt water", "holds 5 litres", PAGE), ("d", None, None, None)]
    got = support.assess(spark.createDataFrame(rows, "id string, claim string, excerpt string, page string"))
    assert {r.id: r.context for r in got.collect()}["a"] == PAGE[PAGE.index("The vat") :]
    judged = spark.createDataFrame([("a", True, []), ("b", True, []), ("c", False, ["direction"])], "id string, supported boolean, issues array<string>")
    assert {r.id: (r.supported, r.codes) for r in support.combined(got, judged).collect()} == {"a": (True, ""), "b": (False, "claim_empty"), "c": (False, "direction"), "d": (False, "claim_empty")}
    alone = support.combined(got.where("id = 'a'"), judged.limit(0)).first()
    assert (alone.supported, alone.codes) == (False, "semantic_validation_missing")


def test_study_queue(spark):
    now = 1_773_576_000_000  # 2026-03-15T12:00Z
    known = spark.createDataFrame([(f"n{i:02}", "u", f"2026-01-{i + 1:02}", "x") for i in range(25)] + [("due", "u", "2026-01-01", "x"), ("later", "u", "2026-01-01", "x"), ("today", "u", "2026-01-01", "x"), ("off", "u", "2026-01-01", None)], "id string, owner_id string, created_at string, claim string")
    rows = [("a", "due", 1, 4, "2026-03-01T10:00:00Z"), ("b", "later", 1, 4, "2026-03-10T10:00:00Z"), ("b2", "later", 1, 4, "2026-03-12T10:00:00Z"), ("c", "today", 1, 4, "2026-03-15T09:00:00Z"), ("d", "gone", 1, 4, "2026-03-15T09:00:00Z")]
    e = events(spark, rows)
    r = study.counts(known, e, now).first().asDict()
    assert r == {"user_id": "u", "eligible": 20, "new": 25, "due": 1, "later": 2, "suspended": 1, "deferred_new": 6, "deferred_review": 0}
    got = [(x.position, x.card_id) for x in study.queue(known, e, now).orderBy("position").collect()]
    assert got == [(1, "due")] + [(i + 2, f"n{i:02}") for i in range(19)]
    whole = [x.card_id for x in study.cram(known, e, now).orderBy("position").collect()]
    assert whole[0] == "due" and whole[-2:] == ["later", "today"] and len(whole) == 28 and "off" not in whole


def test_gates_are_unmet_without_a_denominator(spark):
    c = spark.createDataFrame([(f"c{i}", "j", "included_eligible", f"k{i}" if i < 9 else None) for i in range(10)] + [("x", "o", "excluded_duplicate", None)], "id string, job_id string, decision string, card_id string")
    v = spark.createDataFrame([("k0", True, False), ("k1", False, True), ("zz", True, None)], "card_id string, supported boolean, critical boolean")
    got = {(r.job_id, r.gate): (r.status, r.value) for r in evaluation.gates(evaluation.metrics(c, v)).collect()}
    assert got == {("j", "supported_claims"): ("fail", 0.5), ("j", "comprehensive_coverage"): ("pass", 0.9), ("j", "critical_errors"): ("fail", 0.5), ("o", "supported_claims"): ("unmet", None), ("o", "comprehensive_coverage"): ("unmet", None), ("o", "critical_errors"): ("unmet", None)}
    assert [r.card_id for r in evaluation.unknown_verdicts(v, c).collect()] == ["zz"]


def test_markdown_pages_and_sections():
    text = "# One\r\n\nlead\n\n```\n# no heading\n```\n\nUnder it\nTitle line\n---\n\n### Deep ###\nx\n\n## Two"
    blocks = ingest.markdown_blocks(text)
    assert [(b.level, b.text) for b in blocks] == [(1, "One"), (0, "lead"), (0, "```\n# no heading\n```"), (2, "Under it"), (3, "Deep ###"), (0, "x"), (2, "Two")]
    pages = [[ingest.Block("One", 1)], [ingest.Block("A", 2), ingest.Block("B", 3)], [ingest.Block("C", 2)], [ingest.Block("D", 1)]]
    assert [s[:2] + s[3:] for s in ingest.heading_sections(pages)] == [(1, None, 1, 1, 3), (2, 1, 2, 2, 2), (3, 2, 3, 2, 2), (4, 1, 2, 3, 3), (5, None, 1, 4, 4)]
    long = ingest.split_long([ingest.Block("a" * 30 + "\n" + "b" * 30 + "\n" + "c" * 90), ingest.Block("h" * 99, 1)], 70)
    assert [b.text for b in long] == ["a" * 30 + "\n" + "b" * 30, "c" * 90, "h" * 99]
    made, kind = ingest.paged([[], [ingest.Block("a" * 40), ingest.Block("b" * 40)], [ingest.Block("c")], []], 50)
    assert ([[b.text[0] for b in p] for p in made], kind) == ([["a"], ["b"], ["c"]], "mixed")
    assert [(s[2], s[4], s[5]) for s in ingest.chunk_sections([5] * 8)] == [("Pages 1–2", 1, 2), ("Pages 3–4", 3, 4), ("Pages 5–6", 5, 6), ("Pages 7–8", 7, 8)]


def test_pages_of_texts(spark):
    d = spark.createDataFrame([(1, "a b\n\n\n c \n\n  \n\nd", "x"), (2, None, "x"), (3, "", "x"), (4, "\n\n".join(["w " * 600] * 5), "x")], "doc_id long, text string, blocks string")
    got = {}
    for r in ingest.text_pages(d).collect():
        got.setdefault(r.doc_id, []).append((r.page_number, r.blocks, r.n_words, r.kind))
    assert got == {1: [(1, 3, 4, "text")], 2: [(1, 0, 0, "blank")], 3: [(1, 0, 0, "blank")], 4: [(1, 2, 1200, "text"), (2, 2, 1200, "text"), (3, 1, 600, "text")]}
    assert ingest.text_sections(d.limit(0)).count() == 0


def test_formats_by_wording_before_kind(spark):
    rows = [("a", "causal", "it holds 5 mV in all of them"), ("b", "causal", "5 mV"), ("c", "quantity", "this is called a vat here"), ("d", "definition", "it falls because of rain"), ("e", "definition", "it is moved by wind"), ("f", "definition", "one two three four"), ("g", "relational", None), ("h", "mechanism", "plain words stand here")]
    got = {r.concept_id: (r.format, r.reason) for r in inventory.formats(spark.createDataFrame(rows, "id string, kind string, source_excerpt string")).collect()}
    assert got == {"a": ("cloze", "content_cues_quantity"), "b": ("qa", "fallback_relational"), "c": ("cloze", "content_cues_definition"), "d": ("qa", "content_cues_causal"), "e": ("qa", "content_cues_mechanism"), "f": ("cloze", "concept_definition"), "g": ("qa", "concept_relational"), "h": ("qa", "concept_mechanism")}


def test_cards_that_say_the_same_are_kept_once(spark):
    text = "the old vat keeps its pressure through every cold night here"
    rows = [("a", "d", "1", text, None), ("b", "d", "2", text + "!", None), ("c", "d", "3", text.replace("keeps", "never keeps"), None), ("e", "d", "4", None, text), ("f", "x", "5", text, None)]
    got = {r.card_id: r.kept_id for r in plans.distinct_cards(spark.createDataFrame(rows, "id string, deck_id string, created_at string, question string, cloze_text string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "e": "a", "f": "f"}


def test_stream_counts_each_event_once(spark, tmp_path):
    rows = ratings(4, 3) + [("e0", "c", 1, 4, "2026-01-01T10:00:00.000Z"), ("far", "c", 1, 4, "2026-03-20T10:00:00.000Z")]
    events(spark, rows).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))
    q = daily_counts(stream).writeStream.outputMode("append").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.day.day, r.reviews) for r in spark.sql("select * from daily").collect()}
    assert got == {(1, 1), (2, 1)}
