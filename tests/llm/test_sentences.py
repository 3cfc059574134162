import pytest

from groundwork.llm import sentences
from groundwork.llm.sentences import Splitter

CASES = [
    ["Dr. Vososabox drew it in Fig. 6.", "J. K. Ganupakod saw St. Rizonekune, No. 11, at 5.3 mm.", "It ends at 35 p.m.", "In practice, e.g. the vat, approx. 5 cm, etc.", "Release 2.14.1 is out."],
    ["“Is it worn?” asked Masirufik at the filter.", "Sadukebil wrote, “The cornice is naïve. Nothing else cools it.”", "\"Close the drone!\" shouted Dofukurad, but it was brittle.", "(The tide is shown in Table 2.)", "Fezusa et al. found a flange.[11]", "What fails first?!", "The ratio (cf. vol. 5, pp. 8) is low."],
    ["Am 3. Mai prüfte Dr. Lepukanird das Gewölbe.", "Das gilt d. h. nur für das 19. Jahrhundert.", "Siehe Abb. 38 bzw. Nr. 95 im Anhang.", "Nevotefat schrieb: „die Füllung ist dicht. Mehr wissen wir nicht.“", "„Ist der Kessel zäh?“, fragte Sovidupat am Abend."],
    ["Mme Deraputine a noté : « la pente change. Rien d'autre ne bouge. »", "Voir fig. 38, p. 3.", "Après 74 jours, le four devient plus épais."],
    ["Véase la fig. 14 del vol. 77, pág. 92.", "Gunenopelt anotó: «la junta cambia. Lo demás no.»", "¿Por qué cambia?"],
    ["Проф. Kemofonul проверил трубу в 1917 г. и записал итог.", "Нужны трубы, доски и т. д.", "Шлюз защищает поверхность.", "«Где колесо?» — спросил Digirurit."],
]
UNSPACED = [
    ["详见图86（第3页）。", "Deraputine写道：“滤网已经修好。接缝也正常。”", "“渠道坚固吗？”老师问道。", "「水流太高了！」他喊道。", "低1.4度。"],
    ["「水路は丈夫ですか。」と先生が尋ねた。", "Lamafetikは「粘土層は直った。表面も正常だ」と書いた。", "水門を開けてはいけない！"],
]


@pytest.mark.parametrize("case", CASES)
def test_spaced_scripts(case):
    text = " ".join(case)
    assert [text[a:b] for a, b in Splitter().split(text)] == case


@pytest.mark.parametrize("case", UNSPACED)
def test_scripts_without_spaces(case):
    text = "".join(case)
    assert [text[a:b] for a, b in Splitter().split(text)] == case


def test_thai_hindi_arabic():
    thai = ["ทำไมท่อจึงเปลี่ยนไป", "เมื่อผ่านไป 7 วันแรงดันของเตาเผาจะลดลง", "ชั้นดินทำให้พื้นผิวเปลี่ยนไปอย่างช้าๆ", "ถ้าไม่มีชั้นดินแรงดันจะไม่คงที่"]
    hindi = ["डॉ. Vososabox ने जलद्वार को फिर से परखा।", "“जलद्वार कहाँ है?” छात्र ने पूछा।", "4 दिन बाद घट जाता है।"]
    arabic = ["راجع د. Vososabox الحرارة مرة أخرى.", "قال المعلم: «أين السد؟ لا أراه.»", "يغير السد الأنبوب غالبا."]
    for case in (thai, hindi, arabic):
        text = " ".join(case)
        assert [text[a:b] for a, b in Splitter().split(text)] == case


def test_layout():
    text = "  Notes on decay\n\nThe vat keeps its pressure for\nabout 5 mm, and the lens set-\ntles late. It is worn.\nCheck the following:\n1. The vat is worn. It leaks.\n2. The seam\n- damp loam\n\nQuestions\n\nIt ends "
    got = [text[a:b] for a, b in Splitter().split(text)]
    assert got == ["Notes on decay", "The vat keeps its pressure for\nabout 5 mm, and the lens set-\ntles late.", "It is worn.", "Check the following:", "1. The vat is worn. It leaks.", "2. The seam", "- damp loam", "Questions", "It ends"]


def test_offsets_cover_every_sign_once(spark):
    texts = [" ".join(c) for c in CASES] + ["".join(c) for c in UNSPACED] + ["😀 One. Two 👩‍🔬.　Three", "a" * 200_000, ". . .", None, "", " \n "]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(99, "One. Two.", "x"), (99, "One. Two.", "x")], "doc_id long, text string, char_start string")
    rows = sentences.split_documents(df).collect()
    for i, t in enumerate(texts):
        mine = sorted((r.char_start, r.char_end, r.sentence) for r in rows if r.doc_id == i)
        assert all(t[a:b] == s == s.strip() != "" for a, b, s in mine)
        assert "".join("".join(s.split()) for *_, s in mine) == "".join((t or "").split())
        assert all(x[1] <= y[0] for x, y in zip(mine, mine[1:]))
    assert sum(r.doc_id == 99 for r in rows) == 4
    assert sentences.split_documents(df.limit(0)).count() == 0


def test_the_document_and_the_corpus_tell_abbreviations(spark):
    corpus = [(i, "The qx. of the vat is low, and qx. 5 too. She met qx. Bando.") for i in range(20)]
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    known = sentences.learn(df)
    assert known.abbreviations["qx"] is False and "vat" not in known.abbreviations
    alone = "She met qx. Bando there. It ends."
    assert len(Splitter(known).split(alone)) == 2 and len(Splitter().split(alone)) == 3
