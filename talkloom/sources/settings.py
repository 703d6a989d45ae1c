"""Settings: a flat JSON object on the driver, read by a declared schema."""

from __future__ import annotations

import json
from itertools import count
from pathlib import Path
from typing import NamedTuple


class Setting(NamedTuple):
    """Default, kind of value, and the least number allowed."""

    default: object
    kind: str
    least: float | None = None


SCHEMA: dict[str, Setting] = {
    "language": Setting("ja", "text"),
    "final_channel_policy": Setting("auto_dedupe", "text"),
    "summary_sections": Setting([], "names"),
    "summary_extra_instructions": Setting("", "text"),
    "fast_summary": Setting(True, "flag"),
    "speaker_labels": Setting(True, "flag"),
    "live_backend": Setting("auto", "text"),
    "record_mic": Setting(True, "flag"),
    "live_window_sec": Setting(8.0, "number", 0),
    "live_interval_sec": Setting(1.2, "number", 0),
    "live_stable_margin_sec": Setting(1.5, "number", 0),
    "live_min_audio_sec": Setting(0.8, "number", 0),
    "calendar_title_hint": Setting(False, "flag"),
    "calendar_lookback_min": Setting(15, "whole", 0),
    "calendar_lookahead_min": Setting(10, "whole", 0),
}
DEFAULTS: dict[str, object] = {name: setting.default for name, setting in SCHEMA.items()}
_FLAGS = {"true": True, "false": False}


def _names(value: object) -> list[str]:
    if isinstance(value, str):
        value = [part.strip() for part in value.split(",")]
    if not isinstance(value, list):
        raise TypeError("no list of names")
    return [str(v) for v in value if str(v).strip()]


#: How a value of each kind is read; ValueError and TypeError mean that it is none.
CONVERSIONS = {
    "text": str,
    "flag": lambda value: _FLAGS.get(str(value).strip().lower(), bool(value)),
    "whole": int,
    "number": float,
    "names": _names,
}


def _value(setting: Setting, given: object) -> object:
    try:
        read = CONVERSIONS[setting.kind](given)
    except (TypeError, ValueError):
        return setting.default
    return setting.default if setting.least is not None and read < setting.least else read


def coerce(raw: object, schema: dict[str, Setting] = SCHEMA) -> dict[str, object]:
    """Every setting of the schema: as given where it can be read and is not below
    its least value, else its default. Names that the schema lacks go."""
    if not isinstance(raw, dict):
        raise ValueError("settings must be a JSON object")
    return {name: _value(setting, raw.get(name, setting.default)) for name, setting in schema.items()}


def load(path: str, schema: dict[str, Setting] = SCHEMA) -> dict[str, object]:
    """Settings of a file; defaults without one. A file that cannot be read is renamed,
    and the result tells why (_load_error) and its new name (_set_aside, empty if
    renaming failed)."""
    file = Path(path)
    if not file.exists():
        return coerce({}, schema)
    try:
        return coerce(json.loads(file.read_text(encoding="utf-8")), schema)
    except (OSError, ValueError) as e:
        aside = next(p for n in count(1) if not (p := file.with_name(f"{file.name}.broken-{n}")).exists())
        try:
            file.rename(aside)
        except OSError:
            aside = ""
        return coerce({}, schema) | {"_load_error": f"{file}: {e}", "_set_aside": str(aside)}


def save(settings: dict[str, object], path: str) -> None:
    """Writes the schema's settings; notes such as _load_error are not kept."""
    Path(path).write_text(json.dumps(coerce(settings), ensure_ascii=False, indent=2), encoding="utf-8")


def live_backend(settings: dict[str, object], has_gpu: bool) -> str:
    """rolling, native or off: auto takes rolling with a GPU, else native; native
    needs a microphone."""
    wanted = str(settings.get("live_backend", "auto"))
    chosen = ("rolling" if has_gpu else "native") if wanted == "auto" else wanted
    if chosen == "native" and not settings.get("record_mic", True):
        chosen = "rolling" if has_gpu else "off"
    return chosen


def fallback_backend(failed: str, has_gpu: bool, fell_back: bool) -> str:
    """What follows a backend that failed: one fallback, from native to rolling."""
    return "rolling" if failed == "native" and has_gpu and not fell_back else "off"
