"""Job settings: TOML files, precedence of command line, file and environment."""

from __future__ import annotations

import time
import tomllib
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from pathlib import Path


def load_settings(path: str | Path, known: frozenset[str], aliases: Mapping[str, str] = {"from": "source_lang", "to": "target_lang"}) -> dict:  # noqa: B006
    """Settings of a TOML file; unknown keys are an error."""
    raw = {aliases.get(k, k): v for k, v in tomllib.loads(Path(path).read_text(encoding="utf-8")).items()}
    if extra := sorted(set(raw) - known):
        raise ValueError(f"{path}: unknown settings: {', '.join(extra)}")
    return raw


def first_given(*sources: Mapping[str, object]) -> dict:
    """Each setting from the first source that gives it; None counts as not given."""
    out: dict = {}
    for s in sources:
        for k, v in s.items():
            if v is not None:
                out.setdefault(k, v)
    return out


def name_list(text: str | None) -> list[str]:
    """Names separated by commas, trimmed, without empty ones."""
    return [n.strip() for n in (text or "").split(",") if n.strip()]


def resolve_api(settings: Mapping[str, str], env: Mapping[str, str], prefix: str = "TIDEMARK_TRANSLATE_") -> dict[str, str]:
    """Access to a translation service: address and model come from the environment before the file, the key from
    the file before the environment."""
    shell = {name: env.get(prefix + name.upper()) for name in ("base_url", "model", "api_key")}
    public = {n: shell[n] if shell[n] is not None else settings.get(n, "") for n in ("base_url", "model")}
    return {**public, "api_key": settings.get("api_key") or shell["api_key"] or ""}


@dataclass(frozen=True)
class Job:
    """A job's own settings and the paths that follow from them."""

    video: str
    source_lang: str
    target_lang: str
    output: str = ""
    workdir: str = ""

    def __post_init__(self) -> None:
        if self.source_lang == self.target_lang:
            raise ValueError("source and target language are the same")

    @property
    def stem(self) -> str:
        return Path(self.video).stem

    @property
    def output_path(self) -> str:
        return self.output or str(Path(self.video).with_name(f"{self.stem}_{self.target_lang}.mp4"))

    @property
    def work_path(self) -> str:
        return self.workdir or str(Path(self.video).absolute().parent / f"{self.stem}_dubwork")

    @property
    def audio_path(self) -> str:
        return str(Path(self.work_path) / f"{self.stem}.wav")


def chosen_stages(text: str, known: Mapping[str, object]) -> list[str]:
    """Stages of a comma-separated list in the given order; all unknown ones are named before anything runs."""
    wanted = [s.strip() for s in text.split(",")]
    if odd := [s for s in wanted if s not in known]:
        raise ValueError(f"unknown stages: {', '.join(odd)}")
    return wanted


def run_stages(text: str, stages: Mapping[str, Callable[[Job], object]], job: Job) -> dict[str, float]:
    """Run the chosen stages one after the other; the seconds of each."""
    took = {}
    for name in chosen_stages(text, stages):
        began = time.monotonic()
        stages[name](job)
        took[name] = time.monotonic() - began
    return took
