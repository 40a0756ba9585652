"""Around the external programs: pages as images, several programs at once, recognition models in a folder."""

from __future__ import annotations

import os
import subprocess
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..shipping import ship
from .pdf_pages import page_count
from .readers import has_language_data, languages_of, run_tool

# Resolution of a preview, processes at once, languages of which models are wanted besides the one for
# orientation, and the fewest bytes a model has.
PREVIEW_DPI, MOST_PROCESSES, MODELS, ORIENTATION, LEAST_MODEL = 72, 16, "deu+eng", "osd", 1 << 20


def page_image(content: bytes, page: int = 1, dpi: int = PREVIEW_DPI, settings: Settings | None = None) -> bytes | None:
    """PNG of one page, counted from 1; None without the program, for a page that isn't there, or if it fails.

    Pages of files that the Python reader can't count are left to the program, which fails beyond the last.
    """
    program = (settings or Settings()).executable("pdftoppm")
    if program is None or b"%PDF-" not in content[:1024] or page < 1 or page > (page_count(content) or page):
        return None
    with tempfile.TemporaryDirectory() as d:
        source, target = Path(d, "in.pdf"), Path(d, "page")
        source.write_bytes(content)
        ran = run_tool([program, "-png", "-r", str(dpi), "-f", str(page), "-l", str(page), "-singlefile", str(source), str(target)])
        made = target.with_suffix(".png")
        return made.read_bytes() if ran is not None and made.exists() else None


def page_images(files: DataFrame, page: int = 1, dpi: int = PREVIEW_DPI, settings: Settings | None = None) -> DataFrame:
    """(path, page, image, base64) of rows (path, content), rendered inside the tasks; null image where there is none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made = [page_image(c, page, dpi, settings) if c is not None else None for c in rows["content"]]
            yield pd.DataFrame({"path": rows["path"], "image": pd.Series(made, dtype=object)})

    ship(files.sparkSession)
    rows = files.select("path", "content").mapInPandas(run, "path string, image binary")
    return rows.select("path", F.lit(page).alias("page"), "image", F.base64("image").alias("base64"))


def run_all(commands: Mapping[Hashable, list[str]], most: int | None = None) -> dict[Hashable, int]:
    """Exit codes by key of programs that run side by side, -1 where one can't be started; what they print is dropped.

    For one machine, at most ``most`` at once (the cores, if not given) and never over 16; over many files Spark's
    tasks are the pool.
    """

    def code(arguments: list[str]) -> int:
        try:
            return subprocess.run(arguments, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL).returncode
        except OSError:
            return -1

    width = max(1, min(most if most is not None else os.cpu_count() or 4, MOST_PROCESSES))
    with ThreadPoolExecutor(width) as pool:
        return dict(zip(commands, pool.map(code, commands.values()), strict=True))


def has_models(folder: str) -> bool:
    """Whether a folder holds any model."""
    return any(Path(folder).glob("*.traineddata"))


def ensure_models(folder: str, fetch: Callable[[str], bytes | None], languages: str | None = None) -> bool:
    """Fetches models that are missing and says whether all are there; for the driver, never from tasks.

    ``fetch`` gives a model's bytes by its language; what is under a mebibyte isn't one. Files are written under
    another name and renamed, so no half a model is ever seen.
    """
    try:
        Path(folder).mkdir(parents=True, exist_ok=True)
    except OSError:
        return False
    whole = True
    for name in dict.fromkeys([ORIENTATION, *languages_of(MODELS if languages is None else languages)]):
        target = Path(folder, f"{name}.traineddata")
        if target.is_file():
            continue
        part = target.with_name(f"{target.name}.{uuid.uuid4().hex}.part")
        try:
            body = fetch(name)
            if body is None or len(body) < LEAST_MODEL:
                whole = False
                continue
            part.write_bytes(body)
            part.replace(target)
        except OSError:
            part.unlink(missing_ok=True)
            whole = False
    return whole


def usable_models(folder: str, fetch: Callable[[str], bytes | None] | None = None, languages: str | None = None) -> str | None:
    """The folder, if it holds the languages' models or they can be fetched; else None."""
    wanted = MODELS if languages is None else languages
    if has_models(folder) and has_language_data(wanted, folder):
        return folder
    return folder if fetch is not None and ensure_models(folder, fetch, wanted) else None
