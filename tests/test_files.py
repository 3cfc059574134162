import io
import zipfile

from pyspark.sql import functions as F

from groundwork.operators import evaluation, figures, reviews, simulate, store
from groundwork.sources import office

W = 'xmlns:w="w" xmlns:a="a" xmlns:r="r"'
RELS = '<Relationships xmlns="x">{}</Relationships>'
PNG = b"\x89PNG\r\n\x1a\n" + b"x" * 8


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name.replace("__", "/"), data)
    return out.getvalue()


def word(body, media=()):
    parts = {"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"}
    parts |= {f"word/media/{n}": d for n, d in media}
    parts["word/_rels/document.xml.rels"] = RELS.format("".join(f'<Relationship Id="r{i}" Type="t/image" Target="media/{n}"/>' for i, (n, _) in enumerate(media)) + '<Relationship Id="far" Type="t/image" Target="http://x/y.png"/>')
    return archive(**parts)


def para(text, mark="", end=""):
    return f"<w:p>{mark}<w:r><w:t>{text}</w:t></w:r>{end}</w:p>"


def style(name):
    return f'<w:pPr><w:pStyle w:val="{name}"/></w:pPr>'


BREAK = '<w:r><w:br w:type="page"/></w:r>'


def test_word_files():
    picture = '<w:p><w:r><a:blip r:embed="r0"/></w:r></w:p>'
    s = office.read_word(word(para("Titel", style("Title")) + para("a &amp; b", end=BREAK) + picture + para("Figure 2 shows it") + para("Deep", style("Überschrift3")), [("p.png", PNG), ("loose.gif", b"GIF89a")]))
    assert s.pagination == "explicit" and s.pages == [("Titel\n\na & b", "text"), ("Figure 2 shows it\n\nDeep", "text")]
    assert [(x[2], x[3], x[4], x[5], x[1]) for x in s.sections] == [("Titel", 1, 1, 2, None), ("Deep", 3, 2, 2, 1)]
    assert [(m["page_number"], m["name"], m["content_type"], m["caption"]) for m in s.media] == [(2, "p.png", "image/png", "Figure 2 shows it"), (0, "loose.gif", "image/gif", None)]
    only = office.read_word(word(para("x", end=BREAK) + picture, [("p.png", PNG)]))
    assert [k for _, k in only.pages] == ["text", "image-only"]
    assert office.read_word(word("")).pages == [("", "blank")]
    assert office.read_file("a.docx", b"no archive").problem == "BadZipFile" and office.read_word(archive(x="y")).problem == "no document part"


def slide(*shapes, table=""):
    return f'<p:sld xmlns:p="p" xmlns:a="a">{"".join(shapes)}{table}</p:sld>'


def shape(text, kind=""):
    mark = f'<p:ph type="{kind}"/>' if kind else ""
    return f"<p:sp>{mark}<a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:sp>"


def test_slides():
    table = "<a:tbl><a:tc><a:p><a:t>cell</a:t></a:p></a:tc></a:tbl>"
    data = archive(**{
        "ppt/slides/slide10.xml": slide(shape("last")), "ppt/slides/slide2.xml": slide(), "ppt/slides/slide1.xml": slide(shape("body"), shape("Head", "title"), table=table),
        "ppt/slides/_rels/slide1.xml.rels": RELS.format('<Relationship Id="n" Type="t/notesSlide" Target="../notesSlides/n1.xml"/>'), "ppt/notesSlides/n1.xml": slide(shape("a note"), shape("12")),
        "ppt/slides/_rels/slide2.xml.rels": RELS.format('<Relationship Id="i" Type="t/image" Target="../media/i.png"/>'), "ppt/media/i.png": PNG, "ppt/media/master.png": PNG,
    })
    s = office.read_slides(data)
    assert s.pages == [("Head\n\nbody\ncell\n\na note", "text"), ("", "image-only"), ("last", "text")]
    assert [x[2] for x in s.sections] == ["Head (Slide 1)", "Slide 2", "last (Slide 3)"]
    assert [(m["page_number"], m["name"]) for m in s.media] == [(2, "i.png"), (0, "master.png")]


def test_files_by_format(spark, tmp_path):
    for name, data in {"a.md": b"# One\n\ntext", "b.txt": "ü\n\nx".encode(), "c.png": PNG, "d.jpg": b"no picture", "e.zip": b"z", "f.docx": word(para("x")), ".txt": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    df = office.files(spark, str(tmp_path))
    got = {r.path.rpartition("/")[2]: (r.format, r.page_number, r.kind, r.problem) for r in office.file_pages(df).collect()}
    want = {"a.md": ("markdown", 1, "text", None), "b.txt": ("text", 1, "text", None), "c.png": ("image", 1, "image-only", None), "d.jpg": ("image", None, None, "not a picture"), "e.zip": (None, None, None, "other container"), "f.docx": ("docx", 1, "text", None)}
    assert {k: v for k, v in got.items() if k != ".txt"} == want
    assert {r.title for r in office.file_sections(df.where("path like '%.md'")).collect()} == {"One"}
    assert [(r.page_number, r.content_type, r.size) for r in office.file_media(df.where("path like '%.png'")).collect()] == [(1, "image/png", 16)]
    assert [office.image_type(x) for x in (b"\xff\xd8\xff.", b"RIFF0000WEBP", b"BM" + b"0" * 12, b"GIF88a", b"")] == ["image/jpeg", "image/webp", "image/bmp", None, None]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "ask.v2.md").write_text("Say it.")
    assert [(r.name, r.version, r.text) for r in office.prompts(spark, str(tmp_path / "p")).collect()] == [("ask", 2, "Say it.")]


def test_pictures_kept_within_limits(monkeypatch):
    monkeypatch.setattr(office, "MEDIA_TOTAL", 20)
    package = office.Package(archive(**{"m/a": b"1" * 15, "m/b": b"2" * 15, "m/c": b"3" * 5}))
    kept, skipped = package.media("m/")
    assert sorted(kept) == ["m/a", "m/c"] and skipped == 1


def test_figures_beside_evidence(spark):
    f = spark.createDataFrame([("f1", 1, "figure", "b", "granite valley", None, True), ("f2", 1, "figure", "a", None, "granite valley ochre", True), ("f3", 2, "figure", "c", "x", None, True), ("f4", 3, "scan", "s", None, None, True), ("f5", 3, "figure", "z", "ochre", None, False)], "id string, page_index int, kind string, name string, caption string, context string, page_anchored boolean")
    e = spark.createDataFrame([("e1", 1, "a granite thing"), ("e2", 1, "Granite of the valley"), ("e3", 2, "nothing shared"), ("e4", 3, "any"), ("e5", 3, None)], "id string, page_index int, excerpt string")
    assert {tuple(r) for r in figures.supporting(f, e).collect()} == {("e2", "f2", 1), ("e2", "f1", 2), ("e3", "f3", 1), ("e4", "f4", 1), ("e5", "f4", 1)}
    m = spark.createDataFrame([("1", "x/Ä b.png", "image/png", b"abc"), ("2", None, "image/png", b"abc"), ("3", "c.svg", "image/svg+xml", b"abc"), ("4", "d.png", "image/png", b"")], "id string, name string, content_type string, bytes binary")
    assert {r.id: (r.file_name, r.reason) for r in figures.export_names(m).collect()} == {"1": ("__b-a9993e36.png", None), "2": ("figure-a9993e36.png", None), "3": (None, "type"), "4": (None, "no bytes")}


def test_scan_plan_passes_over_what_does_not_fit(spark):
    p = spark.createDataFrame([("v", f"b{i}", i) for i in range(1, 6)], "version_id string, block_id string, page_index int")
    m = spark.createDataFrame([("v", "m1", 1, 5), ("v", "m1b", 1, 3), ("v", "m2", 2, 11), ("v", "m3", 3, 8), ("v", "m4", 4, 4)], "version_id string, media_id string, page_index int, size int")
    got = {r.block_id: (r.media_id, r.verdict) for r in figures.scan_plan(p, m, 2, 10, 12).collect()}
    assert got == {"b1": ("m1", "planned"), "b2": ("m2", "byte_limit"), "b3": ("m3", "byte_limit"), "b4": ("m4", "planned"), "b5": (None, "unavailable")}


def test_changes_of_tables(spark):
    t = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, n int, s string")
    new = spark.createDataFrame([("b", 5, "q", 1), ("b", 6, "r", 2), ("c", 7, None, 1)], "id string, n int, s string, seq int")
    assert {tuple(r) for r in store.upsert(t, new, "id", "seq").collect()} == {("a", 1, "x"), ("b", 6, "r"), ("c", 7, None)}
    change = spark.createDataFrame([("a", None, True, None, False)], "id string, n int, has_n boolean, s string, has_s boolean")
    assert {tuple(r) for r in store.patch(t, change, "id", ["n", "s"]).collect()} == {("a", None, "x"), ("b", 2, "y")}
    child = spark.createDataFrame([("k1", "a"), ("k2", "b")], "id string, of string")
    leaf = spark.createDataFrame([("l1", "k1"), ("l2", "k2")], "id string, of string")
    left = store.deleted({"t": t, "child": child, "leaf": leaf}, t.where("id = 'a'"), "t", [("child", "of", "t"), ("leaf", "of", "child")])
    assert {n: [r.id for r in df.collect()] for n, df in left.items()} == {"t": ["b"], "child": ["k2"], "leaf": ["l2"]}
    asked = spark.createDataFrame([("1",), ("2",), ("3",), ("1",)], "key string")
    kept = spark.createDataFrame([("1", 1, "sent", None), ("1", 2, "succeeded", "R"), ("2", 1, "sent", None)], "key string, seq int, status string, response string")
    assert {tuple(r) for r in store.answered(asked, kept).collect()} == {("1", "reuse", "R"), ("2", "unresolved", None), ("3", "dispatch", None)}


def test_review_files_are_whole_or_nothing(spark):
    good = '{"verdicts": [{"cardId": "a", "supported": true}, {"cardId": "b", "supported": false, "critical": true}]}'
    bad = '{"verdicts": [{"cardId": "a", "supported": true, "critical": true}, {"supported": true}, {"cardId": "c"}, {"cardId": "d", "supported": true}, {"cardId": "d", "supported": true}]}'
    verdicts, problems = evaluation.review_file(spark.createDataFrame([("g", good), ("b", bad), ("x", "not json")], "file string, text string"))
    assert {tuple(r) for r in verdicts.collect()} == {("g", "a", True, False), ("g", "b", False, True)}
    assert {(r.file, r.position, r.problem) for r in problems.collect()} == {("b", 0, "both supported and critical"), ("b", 1, "no card"), ("b", 2, "not stated whether supported"), ("b", 4, "reviewed twice"), ("x", -1, "no list of verdicts")}


def test_sentence_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(simulate.sentences(F.lit("It is 0.5 mm. In 2020. Next! Is it?  Yes. ."))) == ["It is 0.5 mm.", "In 2020. Next!", "Is it?", "Yes.", "."]
    assert [one(simulate.kind_of(F.lit(t))) for t in ("It is called so since", "It rose by 5 mV", "Thus it fell by wind", "It fell by wind", "Énot by")] == ["definition", "definition", "causal", "mechanism", "mechanism"]
    assert one(simulate.key_term(F.lit("The granite, granite holds Ochre Lichens well."))) == "granite holds Ochre"
    assert one(simulate.key_term(F.lit("It is so to be."))) is None
    assert one(simulate.occurrences(F.lit("aaaa"), F.lit("aa"))) == 2 and one(simulate.tags(F.lit("The granite Granite holds ochre lichens"))) == ["Granite", "Holds", "Ochre"]
    assert [one(simulate.cards_for(F.lit(n), "comprehensive")) for n in (39, 40, 300, 99999)] == [0, 1, 2, 60]


def test_next_review_texts(spark):
    df = spark.createDataFrame([("u", str(d), d) for d in (1, 6, 29, 30, 44, 45, 75)], "user_id string, card_id string, interval_days long")
    assert [r.text for r in reviews.next_review(df).collect()] == ["1 day", "6 days", "29 days", "1 mo", "1 mo", "2 mos", "3 mos"]
