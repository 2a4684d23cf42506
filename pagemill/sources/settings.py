"""Settings, model data, logs and interface texts: configuration on the driver, and the same rules as columns."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES, LANGUAGES = ("Auto", "Fast", "Accurate"), ("English", "Russian", "EnglishRussian", "Auto")


@dataclass(frozen=True)
class Settings:
    mode: str = "Fast"
    language: str = "English"
    start_with_system: bool = False
    close_to_tray: bool = True

    def normalised(self) -> Settings:
        """Unknown values become defaults, Auto language English, both languages Russian; Russian forces Accurate."""
        mode = self.mode if self.mode in MODES else "Fast"
        language = {"Auto": "English", "EnglishRussian": "Russian"}.get(self.language, self.language)
        language = language if language in LANGUAGES else "English"
        return replace(self, mode="Accurate" if language == "Russian" else mode, language=language)


def settings_columns(mode: Column, language: Column) -> dict[str, Column]:
    """``Settings.normalised`` as columns."""
    known = F.when(language == "Auto", "English").when(language == "EnglishRussian", "Russian").when(language.isin(*LANGUAGES), language).otherwise("English")
    return {"language": known, "mode": F.when(known == "Russian", "Accurate").when(mode.isin(*MODES), mode).otherwise("Fast")}


def read_settings(path: str) -> Settings:
    """Settings from JSON; a missing or broken file gives defaults, unknown keys are left out."""
    try:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        names = {x.name for x in fields(Settings)}
        return Settings(**{k: v for k, v in data.items() if k in names}).normalised()
    except (OSError, ValueError, AttributeError, TypeError):
        return Settings()


def write_settings(path: str, settings: Settings) -> None:
    """Written beside and then moved, so a reader never sees half a file; errors are the caller's."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path + ".new", "w", encoding="utf-8") as f:
        json.dump(asdict(settings.normalised()), f, indent=2)
    os.replace(path + ".new", path)


def reconciled(settings: Settings, registered: Callable[[], bool]) -> Settings:
    """Settings with what the system says about starting up; if it cannot be asked, as they are."""
    try:
        return replace(settings, start_with_system=registered())
    except OSError:
        return settings


def saved(settings: Settings, path: str, register: Callable[[bool], None]) -> Settings:
    """Registers first and writes then: a failed registration leaves the file alone."""
    settings = settings.normalised()
    register(settings.start_with_system)
    write_settings(path, settings)
    return settings


def language_codes(language: str) -> list[str]:
    return {"English": ["eng"], "Russian": ["rus"], "EnglishRussian": ["rus", "eng"]}.get(language, ["eng"])


def model_folder(candidates: Iterable[str], language: str, suffix: str = ".traineddata") -> str:
    """The first folder that holds every file the language needs; FileNotFoundError names what is missing."""
    needed = [c + suffix for c in language_codes(language)]
    for folder in candidates:
        if all(os.path.isfile(os.path.join(folder, n)) for n in needed):
            return folder
    raise FileNotFoundError(f"no folder holds {', '.join(needed)}")


class RotatingLog:
    """Appends lines; at ``limit`` bytes the file becomes .1, older ones move up, ``keep`` stay."""

    def __init__(self, path: str, limit: int = 1 << 20, keep: int = 5):
        self.path, self.limit, self.keep = path, limit, keep

    def write(self, line: str) -> None:
        if os.path.exists(self.path) and os.path.getsize(self.path) + len(line) + 1 > self.limit:
            for i in range(self.keep, 0, -1):
                older = self.path if i == 1 else f"{self.path}.{i - 1}"
                if os.path.exists(older):
                    os.replace(older, f"{self.path}.{i}")
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(line + "\n")


def interface_texts(keys: DataFrame, catalogue: DataFrame, language: str) -> DataFrame:
    """(key, text): the current language's text, else English, else the key. catalogue: (language, key, text), unique."""
    of = lambda x, name: catalogue.where(F.col("language") == x).select("key", F.col("text").alias(name))
    met = keys.join(of(language, "_own"), "key", "left").join(of("English", "_english"), "key", "left")
    return met.select("key", F.coalesce("_own", "_english", "key").alias("text"))
