"""Configuration: settings as a dataclass, read from JSON files of key/value rows, and programs by name."""

from __future__ import annotations

import json
import shutil
from dataclasses import dataclass, field, fields, replace

# The settings' defaults.
DEFAULTS = {
    "tesseract_lang": "deu+eng",
    "tesseract_psm": 3,
    "tesseract_auto_select_language": False,
    "ocrmypdf_psm": 11,
    "pdftoppm_dpi": 300,
    "quality_check_enabled": True,
    "quality_threshold": 60.0,
}


@dataclass(frozen=True)
class Settings:
    """What steers extraction. ``executables`` gives a program's path or, by name, where it isn't on the path."""

    tesseract_lang: str = DEFAULTS["tesseract_lang"]
    tesseract_psm: int = DEFAULTS["tesseract_psm"]
    tesseract_auto_select_language: bool = DEFAULTS["tesseract_auto_select_language"]
    ocrmypdf_psm: int = DEFAULTS["ocrmypdf_psm"]
    pdftoppm_dpi: int = DEFAULTS["pdftoppm_dpi"]
    quality_check_enabled: bool = DEFAULTS["quality_check_enabled"]
    quality_threshold: float = DEFAULTS["quality_threshold"]
    executables: dict[str, str] = field(default_factory=dict)

    def executable(self, name: str) -> str | None:
        """The program's path, or None if it can't be run here."""
        return shutil.which(self.executables.get(name) or name)

    def available(self, *names: str) -> bool:
        return all(self.executable(n) for n in names)


def load(*paths: str, base: Settings | None = None) -> Settings:
    """Settings of JSON files, later ones over earlier ones; rows that aren't enabled and unknown keys are passed over."""
    out, known = base or Settings(), {f.name for f in fields(Settings)}
    for path in paths:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        rows = [r for section in data.values() if isinstance(section, list) for r in section]
        out = replace(out, **{r["key"]: r["value"] for r in rows if r.get("enabled", True) and r.get("key") in known and r["key"] != "executables"})
        programs = {k: v["path"] for s in ("shellExecutables", "javaExecutables") for k, v in (data.get(s) or {}).items() if isinstance(v, dict) and v.get("path")}
        out = replace(out, executables=out.executables | programs)
    return out


def command(template: list[str], values: dict[str, str], extra: list[str] = []) -> list[str]:  # noqa: B006
    """Arguments with [NAME] placeholders filled in; those that come out empty are dropped, ``extra`` is appended."""
    out = []
    for part in template:
        for name, value in values.items():
            part = part.replace(f"[{name}]", value)
        if part:
            out.append(part)
    return [*out, *extra]
