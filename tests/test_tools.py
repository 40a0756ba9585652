"""Readers and the renderer with programs of our own in the tools' places."""

import base64

import pytest
from pyspark.sql import functions as F

from foliant.config import Settings
from foliant.operators.provider import TextProvider
from foliant.sources import pdf_pages as pages
from foliant.sources import readers, tools, writers

GOOD = "The annual report of the company and the balance sheet with the audit for this business were prepared."
BAD = "f r f r f r f r f r f r"


def program(folder, name: str, body: str) -> str:
    at = folder / name
    at.write_text(f"#!/bin/sh\n{body}\n")
    at.chmod(0o755)
    return str(at)


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("pdfs")
    for name in ("a", "b"):
        (at / f"{name}.pdf").write_bytes(writers.text_pdf("anything at all"))
    return readers.pdf_files(spark, str(at))


def test_dual_strategy(files, tmp_path):
    found = program(tmp_path, "pdftotext", f'case "$1" in -raw) echo "{GOOD}";; *) echo "{BAD}";; esac')
    settings = Settings(executables={"pdftotext": found})
    got = readers.candidates(files, ["pdftotext"], {"language": "eng"}, settings).collect()
    assert len(got) == 2 and all(r["text"].strip() == GOOD for r in got)
    once = readers.candidates(files, ["pdftotext"], {"language": "eng", "dual": False}, settings).collect()
    assert all(r["text"].strip() == BAD for r in once)


def ocr_settings(tmp_path, tesseract: str, **more) -> Settings:
    pdftoppm = program(tmp_path, "pdftoppm", 'for last; do :; done; : > "$last-1.png"')
    return Settings(executables={"tesseract": program(tmp_path, "tesseract", tesseract), "pdftoppm": pdftoppm, "convert": "/none"}, **more)


def test_cascade_of_settings(files, tmp_path):
    # Arguments: image stdout -l language --psm mode
    settings = ocr_settings(tmp_path, f'echo "$6" >> {tmp_path}/log; if [ "$6" = 4 ]; then echo "{GOOD}"; else echo "{BAD}"; fi', tesseract_lang="eng")
    got = readers.recognised(files, "tesseract", settings=settings).collect()
    assert [(r["reader"], r["psm"], r["dpi"], r["text"]) for r in got] == [("tesseract", 4, 300, GOOD)] * 2
    assert sorted((tmp_path / "log").read_text().split()) == sorted(["3", "6", "4"] * 2)
    without = readers.recognised(files, "tesseract", {"quality_check": False}, settings).collect()
    assert [(r["psm"], r["text"]) for r in without] == [(3, BAD)] * 2


def test_language_choice(files, tmp_path):
    settings = ocr_settings(tmp_path, f'if [ "$4" = eng ]; then echo "{GOOD}"; else echo "{BAD}"; fi', tesseract_auto_select_language=True)
    assert {(r["language"], r["text"]) for r in readers.recognised(files, "tesseract", settings=settings).collect()} == {("eng", GOOD)}


def test_a_missing_recogniser_gives_nothing(files):
    assert readers.recognised(files, "ocrmypdf", settings=Settings(executables={"ocrmypdf": "/none"})).count() == 0


def test_renderer_arguments(tmp_path):
    found = program(tmp_path, "wkhtmltopdf", f'echo "$@" > {tmp_path}/arguments; for last; do :; done; echo made > "$last"')
    writer = writers.ToolWriter(program=found)
    options = {"paper_size": "A5", "orientation": "landscape", "margins": {"top": "10mm", "left": 0}, "dpi": 150, "zoom": 1.5, "grayscale": True, "disable_javascript": True}
    assert writer.available() and writer.render({"content": "a < b", "type": "text", "metadata": {"title": "T"}}, options) == b"made\n"
    given = (tmp_path / "arguments").read_text()
    for x in ("--page-size A5", "--orientation Landscape", "--margin-top 10mm", "--margin-left 0", "--title T", "--dpi 150", "--zoom 1.5", "--grayscale", "--disable-javascript", "--encoding UTF-8"):
        assert x in given
    assert "--margin-right" not in given and "--lowquality" not in given
    slow = writers.ToolWriter(program=program(tmp_path, "slow", "exec sleep 30"))
    assert slow.render({"content": "x", "type": "html"}, {"timeout": 0.2}) is None


def test_shortcuts_and_characters(tmp_path):
    (tmp_path / "page.html").write_text("<p>from a file</p>")
    for made in (writers.html_to_pdf("<p>from a file</p>"), writers.text_to_pdf("from a file"), writers.file_to_pdf(str(tmp_path / "page.html"))):
        assert readers.plain_text(made).strip() == "from a file"
    with pytest.raises(FileNotFoundError):
        writers.file_to_pdf(str(tmp_path / "none.html"))
    assert writers.text_to_pdf("日本語") is None  # rather than question marks


def test_pages_of_odd_files():
    made = writers.text_pdf("one\ftwo\fthree", "t", {"a.xml": b"<endobj stream>"})
    assert pages.page_count(made) == 3 and pages.page_sizes(made)[0] == (595.28, 841.89, 0)
    again = pages.merge([pages.extract(made, 3, 3), made])
    assert readers.plain_text(again).split("\f") == ["three", "one", "two", "three"]
    turned = pages.rotate(pages.rotate(made, 270), 180)
    assert pages.page_sizes(turned)[1] == (595.28, 841.89, 90)
    assert pages.extract(made, 0, 1) is None and pages.extract(made, 3, 4) is None and pages.extract(made, 2, 1) is None
    for bad in (b"", b"%PDF-1.7 nothing", made[:300], made.replace(b"/Kids [5 0 R", b"/Kids [2 0 R"), b"%PDF 1 0 obj << /Type /Catalog /Pages 1 0 R >> endobj /Encrypt"):
        assert pages.pages_of(bad) is None and pages.split(bad) == [] and pages.rotate(bad, 90) is None and pages.merge([made, bad]) is None
    inherited = made.replace(b"/MediaBox [0 0 595.28 841.89] ", b"").replace(b"/Type /Pages ", b"/Type /Pages /MediaBox [10 20 310 420] /Rotate 90 ")
    assert pages.page_sizes(pages.extract(inherited, 2, 2)) == [(300.0, 400.0, 90)]
    cut = pages.crop(made, 10, 20, 100, 50, 0)
    assert [p.box for p in pages.pages_of(cut)] == [(10, 20, 110, 70)] * 3 and pages.crop(made, 0, 0, 0, 5) is None


def test_provider_seeds(spark):
    docs = spark.createDataFrame([(1, True), (2, True), (3, True)], "k int, has_embedded_text boolean")
    cands = spark.createDataFrame([(1, "pdftotext", 10, GOOD, "layout"), (2, "pdftotext", 10, GOOD, "raw"), (3, "pdfbox", 30, GOOD, None)], "k int, reader string, priority int, text string, mode string")
    seeds = spark.createDataFrame([(1, "seed"), (2, "  "), (3, None)], "k int, text string")
    p = TextProvider(docs, cands, "k", seeds=seeds)
    assert {r["k"]: (r["text"], r["reader"]) for r in p.document().collect()} == {1: ("seed", None), 2: (GOOD, "pdftotext"), 3: (GOOD, "pdfbox")}
    got = {(r["k"], r["variant"]): r["text"] for r in p.variants().collect()}
    assert len(got) == 24 and got[1, "layout"] == GOOD and got[1, "raw"] is None and got[2, "raw"] == GOOD and got[3, "rowaligned"] is None
    assert p.everything().where(F.col("best.text") == GOOD).count() == 3


def test_pages_as_images(files, tmp_path):
    found = program(tmp_path, "pdftoppm", 'for last; do :; done; printf "%s" "$*" | sed "s# /.*##" > "$last.png"')
    settings = Settings(executables={"pdftoppm": found})
    made = writers.text_pdf("one\ftwo")
    assert tools.page_image(made, 2, 150, settings) == b"-png -r 150 -f 2 -l 2 -singlefile"
    for page in (0, -1, 3):
        assert tools.page_image(made, page, settings=settings) is None
    assert tools.page_image(b"no pdf", settings=settings) is None
    assert tools.page_image(made, settings=Settings(executables={"pdftoppm": "/none"})) is None
    failing = Settings(executables={"pdftoppm": program(tmp_path, "failing", "exit 1")})
    assert tools.page_image(made, settings=failing) is None
    rows = tools.page_images(files, settings=settings).collect()
    assert len(rows) == 2 and all(base64.b64decode(r["base64"]) == bytes(r["image"]) == b"-png -r 72 -f 1 -l 1 -singlefile" for r in rows)
    assert [r["base64"] for r in tools.page_images(files, 2, settings=settings).collect()] == [None, None]


def test_programs_side_by_side(tmp_path):
    log = tmp_path / "log"
    body = f'echo + >> {log}; sleep 0.1; echo - >> {log}; exit "$1"'
    found = program(tmp_path, "step", body)
    got = tools.run_all({k: [found, str(k % 3)] for k in range(8)} | {"none": ["/none/such"]}, 3)
    assert got == {k: k % 3 for k in range(8)} | {"none": -1} and tools.run_all({}) == {}
    running, most = 0, 0
    for x in log.read_text().split():
        running += 1 if x == "+" else -1
        most = max(most, running)
    assert 1 < most <= 3


def test_models(tmp_path):
    at, asked = str(tmp_path / "models"), []

    def fetch(name: str) -> bytes | None:
        asked.append(name)
        if name == "gone":
            raise OSError(name)
        return {"osd": b"x" * (1 << 20), "deu": b"y" * (1 << 21), "eng": b"z" * (1 << 20), "tiny": b"small"}.get(name)

    assert not tools.has_models(at) and tools.usable_models(at) is None
    assert tools.ensure_models(at, fetch) and asked == ["osd", "deu", "eng"]
    assert tools.ensure_models(at, fetch) and len(asked) == 3  # nothing is fetched twice
    assert tools.has_models(at) and readers.has_language_data(" deu + eng ", at) and readers.has_language_data("", at)
    assert tools.usable_models(at) == at and tools.usable_models(at, languages="deu+fra") is None
    for bad in ("tiny", "gone", "unknown"):
        assert not tools.ensure_models(at, fetch, f"deu+{bad}") and tools.usable_models(at, fetch, bad) is None
    assert sorted(p.name for p in (tmp_path / "models").iterdir()) == ["deu.traineddata", "eng.traineddata", "osd.traineddata"]
