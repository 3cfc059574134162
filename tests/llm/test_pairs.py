import random

from groundwork.llm import pairs

SCHEMA = "id string, format string, question string, answer string, cloze_text string, explanation string, defect string"
Q = "Why does the vat of Pumovik settle after the first frost in winter?"
CLOZE = "The {{c1::vat}} of Pumovik settles after the {{c2::first::which?}} frost."


def found(spark, rows):
    return {(r.card_id, r.defect) for r in pairs.defective_pairs(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)).collect()}


def qa(i, answer, question=Q):
    return (i, "qa", question, answer, None, None)


def test_each_defect(spark):
    cases = {
        "empty_answer": [None, "", "  ", "​", "N/A", "[no answer]", "...", "-", "A:"],
        "copies_question": [Q, Q.upper(), f"Q: {Q}", f"{Q} {Q}"],
        "refusal": ["I'm sorry, but I can't help with that.", "Es tut mir leid, dabei kann ich nicht helfen", "IL M'EST IMPOSSIBLE DE VOUS AIDER ICI.", "As a language model I am unable to verify Pumovik.", "No me es posible responder a esta pregunta."],
        "other_language": ["Es handelt sich um eine Verbindung, die langsam zerfällt.", "这是一种在水下缓慢分解的混合物。", "Se trata de una mezcla que se deshace poco a poco."],
        "truncated_answer": ["It settles, since the fibre of the ve", "It settles after the", "It settles when the load is t-", "The load falls (after", "It settles. The next one is"],
        "": ["I may draw blood as a medic.", "The vote went against my candidate.", "Pumovik", "No", "42", "By 3.5 mm", "A damp vat", "It cannot turn, since the vat blocks it.", "“Sorry, I cannot help” is what the sign says.", f"{Q} It settles because of the weight."],
    }
    rows, want = [], set()
    for defect, answers in cases.items():
        for k, a in enumerate(answers):
            rows.append(qa(f"{defect}{k}", a))
            if defect:
                want.add((f"{defect}{k}", defect))
    assert found(spark, rows + rows) == want


def test_cloze_and_asked_languages(spark):
    rows = [
        ("c1", "cloze", None, None, CLOZE, CLOZE),
        ("c2", "cloze", None, None, CLOZE, "The vat of Pumovik settles after the first frost."),
        ("c3", "cloze", None, None, CLOZE, None),
        ("c4", "cloze", None, None, CLOZE, "Frost makes the soil give way."),
        ("c5", "cloze", None, None, None, "Frost makes the soil give way."),
        ("l1", "qa", "How would you say that the vat is worn in German?", "Der Kessel ist nicht mehr zu gebrauchen und wird ersetzt.", None, None),
        (None, "qa", Q, None, None, None),
        ("f", None, None, None, None, None),
    ]
    assert found(spark, rows) == {("c1", "copies_question"), ("c2", "copies_question"), ("c3", "empty_answer"), ("f", "empty_answer")}


def test_refusals_need_their_negation_and_speaker():
    assert not any(map(pairs.refuses, ["Ich darf als Arzt Blut abnehmen.", "Ich kann das Ventil von Hand schliessen.", "The vote went against my candidate.", "Der Kessel kann nicht helfen, das Rad zu drehen."]))
    assert all(map(pairs.refuses, ["Diese Frage kann ich leider nicht beantworten.", "Ich darf dir dazu keine Auskunft geben.", "I CAN\u2019T ANSWER that.", "That is against our rules, and against my guidelines.", "No me es posible decirlo."]))


def test_common_subsequence_by_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert pairs.common_subsequence(a, b) == row[-1]


def test_rare_open_endings_are_told_by_the_corpus(spark):
    rows = [qa(f"w{i}", f"It needs the vat number {i} for that purpose.") for i in range(40)] + [qa("x", "It needs the vat")] + [qa(f"s{i}", "Near the vat") for i in range(5)]
    assert found(spark, rows) == {("x", "truncated_answer")}


def test_empty_table_and_long_answers(spark):
    assert found(spark, []) == set()
    long = "It settles, as the load falls. " * 20_000
    assert found(spark, [qa("a", long), qa("b", long + "And it")]) == {("b", "truncated_answer")}
