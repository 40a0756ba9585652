"""Sources of text: PDF files as rows, read by external programs where they are installed, or by a small reader in Python.

A reader takes one file's bytes inside a task and gives a text or None. Where its program is missing it
isn't available, is passed over, and its text is null.
"""

from __future__ import annotations

import re
import subprocess
import tempfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings, command
from ..functions.quality import with_quality
from ..operators.select import OCRMYPDF_CASCADE, cascade, dual_strategy, settings_cascade
from ..shipping import ship
from .registry import READERS, Registry

PAGE_MARK = "\n\n--- Seite ---\n\n"
BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")
SKIPPED = re.compile(r"\[OCR skipped on page\(s\) [0-9, -]+\]\s*")


def enough(text: str | None, least: int = 10) -> str | None:
    """The text if it holds ``least`` bytes besides blanks."""
    return text if text is not None and len(BLANKS.sub("", text).encode()) >= least else None


def run_tool(arguments: list[str], timeout: int = 300, ok: tuple[int, ...] = (0,)) -> bytes | None:
    """Standard output of a program with one thread of its own, or None if it fails."""
    try:
        ran = subprocess.run(arguments, capture_output=True, timeout=timeout, env={"OMP_THREAD_LIMIT": "1", "PATH": "/usr/local/bin:/usr/bin:/bin"})
    except (OSError, subprocess.TimeoutExpired):
        return None
    return ran.stdout if ran.returncode in ok else None


@dataclass
class ToolReader:
    """Base of the readers that run a program on a file."""

    name: str
    programs: tuple[str, ...]
    settings: Settings = field(default_factory=Settings)

    @property
    def priority(self) -> int:
        return READERS[self.name][0]

    @property
    def supports_scanned(self) -> bool:
        return READERS[self.name][1]

    @property
    def supports_text(self) -> bool:
        return READERS[self.name][2]

    def available(self) -> bool:
        return self.settings.available(*self.programs)

    def can_handle(self, path: str, content: bytes) -> bool:
        return path.lower().endswith(".pdf") and b"%PDF-" in content[:1024]

    def extract(self, path: str, content: bytes, options: dict) -> str | None:
        with tempfile.TemporaryDirectory() as d:
            at = Path(d, "in.pdf")
            at.write_bytes(content)
            return self.read(at, Path(d), options)

    def read(self, pdf: Path, folder: Path, options: dict) -> str | None:
        raise NotImplementedError


class PdfToText(ToolReader):
    """Layout text, or raw text where ``layout`` is off; ``candidates`` takes the one that scores higher."""

    def __init__(self, settings: Settings | None = None):
        super().__init__("pdftotext", ("pdftotext",), settings or Settings())

    def read(self, pdf: Path, folder: Path, options: dict) -> str | None:
        template = [self.settings.executable("pdftotext"), "[MODE]", "-enc", "UTF-8", "[PDF]", "-"]
        raw = run_tool(command(template, {"MODE": "-layout" if options.get("layout", True) else "-raw", "PDF": str(pdf)}))
        return enough(raw.decode("utf-8", "replace")) if raw is not None else None


class PdfBox(ToolReader):
    def __init__(self, settings: Settings | None = None):
        super().__init__("pdfbox", ("java", "pdfbox-app.jar"), settings or Settings())

    def read(self, pdf: Path, folder: Path, options: dict) -> str | None:
        out = folder / "out.txt"
        jar = self.settings.executables.get("pdfbox-app.jar", "pdfbox-app.jar")
        ran = run_tool([self.settings.executable("java"), "-jar", jar, "export:text", "-i", str(pdf), "-o", str(out)])
        return enough(out.read_text("utf-8", "replace")) if ran is not None and out.exists() else None


class Tesseract(ToolReader):
    """Pages as images, each recognised by a process of one thread; pages are joined by a marker."""

    def __init__(self, settings: Settings | None = None):
        super().__init__("tesseract", ("pdftoppm", "tesseract"), settings or Settings())

    def read(self, pdf: Path, folder: Path, options: dict) -> str | None:
        s = self.settings
        if run_tool([s.executable("pdftoppm"), "-png", "-r", str(options.get("dpi", s.pdftoppm_dpi)), str(pdf), str(folder / "page")]) is None:
            return None
        images = sorted(folder.glob("page*.png"), key=lambda p: int(re.findall(r"\d+", p.stem)[-1]))
        texts = []
        straighten = s.executable("convert") if options.get("deskew", True) else None
        for image in images:
            straight = folder / f"straight-{image.name}"
            if straighten and run_tool([straighten, str(image), "-deskew", "40%", str(straight)]) is not None and straight.exists():
                image = straight
            raw = run_tool([s.executable("tesseract"), str(image), "stdout", "-l", options.get("language", s.tesseract_lang), "--psm", str(options.get("psm", s.tesseract_psm))])
            texts.append((raw or b"").decode("utf-8", "replace").strip())
        return enough(PAGE_MARK.join(t for t in texts if t))


class OcrMyPdf(ToolReader):
    def __init__(self, settings: Settings | None = None):
        super().__init__("ocrmypdf", ("ocrmypdf",), settings or Settings())

    def read(self, pdf: Path, folder: Path, options: dict) -> str | None:
        side, mode = folder / "side.txt", "--force-ocr" if options.get("force_ocr") else "--skip-text"
        arguments = [self.settings.executable("ocrmypdf"), mode, "--sidecar", str(side), "-l", options.get("language", self.settings.tesseract_lang), "--tesseract-pagesegmode", str(options.get("psm", self.settings.ocrmypdf_psm)), str(pdf), str(folder / "out.pdf")]
        ran = run_tool(arguments, timeout=900, ok=(0, 6))
        return enough(SKIPPED.sub("", side.read_text("utf-8", "replace"))) if ran is not None and side.exists() else None


_STREAM = re.compile(rb"<<(?P<dict>(?:[^<>]++|<<[^<>]*+>>|<[^<>]*+>)*)>>\s*stream\r?\n", re.S)
_STREAM_LENGTH = re.compile(rb"/Length\s+(\d+)\b(?!\s+\d+\s+R)")
_SHOWN = re.compile(rb"\((?P<text>(?:[^()\\]|\\.)*)\)\s*(?:Tj|')|\[(?P<array>(?:[^\]\\]|\\.)*)\]\s*TJ|(?P<line>T\*|\bTd\b|\bTD\b)", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|.)", re.S)


def _unescaped(raw: bytes) -> str:
    def one(m: re.Match) -> bytes:
        x = m[1]
        return bytes([int(x, 8) & 255]) if x.isdigit() else {b"n": b"\n", b"r": b"\r", b"t": b"\t"}.get(x, x)

    return _ESCAPE.sub(one, raw).decode("cp1252", "replace")


def streams(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(dictionary, data) of a PDF's streams that are plain or deflated."""
    for m in _STREAM.finditer(content):
        length = _STREAM_LENGTH.search(m["dict"])
        end = m.end() + int(length[1]) if length else content.find(b"endstream", m.end())
        data = content[m.end() : end]
        if b"FlateDecode" in m["dict"]:
            try:
                data = zlib.decompressobj().decompress(data)
            except zlib.error:
                continue
        yield m["dict"], data


def plain_text(content: bytes) -> str | None:
    """The text that a simple PDF's page streams show, pages parted by form feeds; None if there is none."""
    pages = []
    for _, data in streams(content):
        if b"BT" not in data or b"ET" not in data:
            continue
        out: list[str] = []
        for m in _SHOWN.finditer(data):
            if m["line"] is not None:
                if out:
                    out.append("\n")
            elif m["text"] is not None:
                out.append(_unescaped(m["text"]))
            else:
                out += [_unescaped(x) for x in re.findall(rb"\(((?:[^()\\]|\\.)*)\)", m["array"], re.S)]
        pages.append("".join(out))
    return "\f".join(pages) if pages else None


def attachments_of(content: bytes) -> list[tuple[str, bytes]]:
    """(name, data) of a simple PDF's embedded files, in file order."""
    names = re.findall(rb"/Type\s*/Filespec.*?/UF?\s*\(((?:[^()\\]|\\.)*)\)", content, re.S)
    files = [data for head, data in streams(content) if b"/EmbeddedFile" in head]
    return [(_unescaped(n), f) for n, f in zip(names, files, strict=False)]


class PlainPdf(ToolReader):
    """Reads simple PDFs in Python where the text extractor isn't installed; stands in its place."""

    def __init__(self, settings: Settings | None = None):
        super().__init__("pdftotext", (), settings or Settings())

    def extract(self, path: str, content: bytes, options: dict) -> str | None:
        return enough(plain_text(content))


def readers(settings: Settings | None = None) -> Registry:
    """All readers by name; the Python reader stands for the text extractor where that is missing."""
    out, s = Registry(), settings or Settings()
    tool = PdfToText(s)
    out.register("pdftotext", lambda: tool if tool.available() else PlainPdf(s))
    out.register("pdfbox", lambda: PdfBox(s))
    out.register("tesseract", lambda: Tesseract(s))
    out.register("ocrmypdf", lambda: OcrMyPdf(s))
    return out


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the valid PDFs below a folder of any store that Spark reads."""
    from ..functions.text import is_pdf

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.where(is_pdf(F.col("path"), F.col("content")))


def candidates(files: DataFrame, names: list[str] | None = None, options: dict | None = None, settings: Settings | None = None) -> DataFrame:
    """(path, reader, priority, text): what each available reader makes of each file, run inside the tasks.

    Where pdftotext runs, it runs in both modes, unless the option ``dual`` is off: the other mode's text is
    taken if it scores higher. Recognisers run once; ``recognised`` tries settings in turn.
    """
    given = options or {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [r for r in readers(settings).available() if names is None or r.name in names]
        for rows in batches:
            out = []
            for path, content in zip(rows["path"], rows["content"], strict=True):
                for r in own:
                    if r.can_handle(path, content):
                        text, other = r.extract(path, content, given), None
                        if text is not None and isinstance(r, PdfToText) and given.get("dual", True):
                            other = r.extract(path, content, given | {"layout": not given.get("layout", True)})
                        out.append((path, r.name, r.priority, text, other))
            yield pd.DataFrame(out, columns=["path", "reader", "priority", "text", "_other"])

    ship(files.sparkSession)
    rows = files.mapInPandas(run, "path string, reader string, priority int, text string, _other string")
    if not given.get("dual", True):
        return rows.drop("_other")
    language = given.get("language", (settings or Settings()).tesseract_lang)
    rows = rows.withColumn("_first", F.when(F.col("_other").isNotNull(), F.col("text")))  # nothing else needs a score
    rows = with_quality(with_quality(rows, "_first", language, "_s"), "_other", language, "_o")
    return rows.select("path", "reader", "priority", dual_strategy(F.col("text"), F.col("_other"), F.col("_s"), F.col("_o")).alias("text"))


def recognised(files: DataFrame, name: str = "tesseract", options: dict | None = None, settings: Settings | None = None) -> DataFrame:
    """(path, reader, priority, text, language, psm, dpi, score): a recogniser's cascade of settings, a round for each.

    Only files whose best text is under the threshold go on to the next round; a file that the first round makes
    nothing of doesn't. With ``tesseract_auto_select_language`` and several languages, each alone and all together
    are tried so, and the highest score wins. Without ``quality_check`` there is one round.
    """
    s, given = settings or Settings(), options or {}
    languages = given.get("language", s.tesseract_lang)
    listed = [*dict.fromkeys([*languages.split("+"), languages])] if name == "tesseract" and given.get("auto_select_language", s.tesseract_auto_select_language) else [languages]
    if name == "tesseract":
        tries = settings_cascade(given.get("psm", s.tesseract_psm), given.get("dpi", s.pdftoppm_dpi))
    else:
        tries = [t for t in settings_cascade(given.get("psm", s.ocrmypdf_psm), s.pdftoppm_dpi, OCRMYPDF_CASCADE) if t[2] == s.pdftoppm_dpi]
    check, threshold = given.get("quality_check", s.quality_check_enabled), given.get("threshold", s.quality_threshold)
    best = [_cascade(files, name, language, tries if check else tries[:1], threshold, given, s).withColumn("_ord", F.lit(k)) for k, language in enumerate(listed)]
    out = best[0]
    for x in best[1:]:
        out = out.unionByName(x)
    row = F.struct(*[c for c in out.columns if c not in ("path", "_ord")])
    return out.groupBy("path").agg(F.max_by(row, F.struct(F.col("score"), -F.col("_ord"))).alias("r")).select("path", "r.*")


def _cascade(files: DataFrame, name: str, language: str, tries: list[tuple[int, int, int]], threshold: float, given: dict, settings: Settings) -> DataFrame:
    def run_with(psm: int, dpi: int):
        own = given | {"psm": psm, "dpi": dpi, "language": language}

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            reader = readers(settings).get(name)
            for rows in batches:
                texts = [reader.extract(p, c, own) if reader.available() and reader.can_handle(p, c) else None for p, c in zip(rows["path"], rows["content"], strict=True)]
                yield pd.DataFrame({"path": rows["path"], "text": pd.Series(texts, dtype=object)})

        return run

    ship(files.sparkSession)
    rounds, left = [], files
    for k, psm, dpi in tries:
        texts = left.select("path", "content").mapInPandas(run_with(psm, dpi), "path string, text string").where("text IS NOT NULL")
        # Kept, since the next round depends on its scores; lost parts are recognised again.
        scored = with_quality(texts, "text", language).withColumns({"ord": F.lit(k), "psm": F.lit(psm), "dpi": F.lit(dpi)}).persist()
        rounds.append(scored)
        if (k, psm, dpi) == tries[-1]:
            break
        low = scored.where(F.col("score") < threshold).select("path") if k == 0 else left.select("path").join(scored.where(F.col("score") >= threshold), "path", "left_anti")
        left = files.join(low, "path", "left_semi")
        if low.isEmpty():
            break
    every = rounds[0]
    for x in rounds[1:]:
        every = every.unionByName(x)
    won = cascade(every, "path", "ord", threshold=threshold).select("path", "ord")
    out = every.join(won, ["path", "ord"]).withColumns({"reader": F.lit(name), "priority": F.lit(READERS[name][0]), "language": F.lit(language)})
    return out.select("path", "reader", "priority", "text", "language", "psm", "dpi", "score")


def attachments(files: DataFrame) -> DataFrame:
    """(path, ord, filename, content) of embedded files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(p, k, n, d.decode("utf-8", "replace")) for p, c in zip(rows["path"], rows["content"], strict=True) for k, (n, d) in enumerate(attachments_of(c))]
            yield pd.DataFrame(out, columns=["path", "ord", "filename", "content"])

    ship(files.sparkSession)
    return files.mapInPandas(run, "path string, ord int, filename string, content string")


def languages_of(languages: str) -> list[str]:
    return [x for x in dict.fromkeys(part.strip() for part in languages.split("+")) if x]


def has_language_data(languages: str, folder: str) -> bool:
    """Whether all of a+b+c have model files; none asked for is true. Nothing is ever downloaded from tasks."""
    return all(Path(folder, f"{x}.traineddata").is_file() for x in languages_of(languages))
