"""Settings: defaults, deep merge, and sources (dict, JSON file, YAML file)."""

from __future__ import annotations

import copy
import json
from pathlib import Path
from typing import Any

DEFAULTS: dict[str, Any] = {
    "language": "auto",
    "mode": "balanced",
    "max_input_length": 200_000,
    "min_tier": 2,
    "enable_llm": False,
    "enable_era": False,
    "enable_script_analysis": False,
    "enable_topic_segmentation": False,
    "enable_paragraph_aware": False,
    "user_dict_path": None,
    "sentence": {"max_sentence_length": 200, "extra_abbreviations": [], "handle_ellipsis": True, "eos_window": 5},
    "scene": {"target_seconds": 6.0, "base_words_per_second": 3.3, "speech_rate": 1.0, "min_words": 10, "max_words": 50, "allow_single_sentence_overflow": True},
    "subtitle": {"min_chars_per_block": 8, "max_chars_per_block": 15, "time_calculation_method": "proportional", "rules_path": None},
    "length": {"strategy": "B", "min_chars": 3, "max_chars": 15, "prefer_punctuation": True},
    "texttiling": {"min_text_length": 100, "sentence_window": 3, "step_size": 1, "depth_score_threshold": 0.3, "smoothing_passes": 0},
    "prompt": {"creative_level": 5, "max_length": 500, "default_platform": None},
}

#: Lowest tier that a mode lets run; balanced takes the setting.
MODE_TIERS = {"fast": 3, "precise": 1}


def merged(base: dict[str, Any], over: dict[str, Any] | None) -> dict[str, Any]:
    """base with over's entries: dicts merge, everything else (lists too) is replaced."""
    out = copy.deepcopy(base)
    for key, value in (over or {}).items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else copy.deepcopy(value)
    return out


def load(source: dict[str, Any] | str | Path | None = None) -> dict[str, Any]:
    """Defaults with a dict, a .json or a .yaml/.yml file merged over them; another suffix is a ValueError."""
    if source is None or isinstance(source, dict):
        return merged(DEFAULTS, source)
    path = Path(source)
    if path.suffix == ".json":
        return merged(DEFAULTS, json.loads(path.read_text(encoding="utf-8")))
    if path.suffix in (".yaml", ".yml"):
        import yaml

        return merged(DEFAULTS, yaml.safe_load(path.read_text(encoding="utf-8")) or {})
    raise ValueError(f"unknown settings format: {path.suffix or path.name}")


def effective_tier(config: dict[str, Any]) -> int:
    return MODE_TIERS.get(config["mode"], config["min_tier"])


def subtitle_bounds(config: dict[str, Any]) -> tuple[int, int]:
    """Block lengths; invalid ones fall back to the defaults, the larger is capped at 64."""
    low, high = int(config["subtitle"]["min_chars_per_block"]), int(config["subtitle"]["max_chars_per_block"])
    if not 1 <= low <= high:
        low, high = DEFAULTS["subtitle"]["min_chars_per_block"], DEFAULTS["subtitle"]["max_chars_per_block"]
    high = min(high, 64)
    return min(low, high), high


def check_length(strategy: str, low: int, high: int) -> None:
    if strategy not in ("A", "B", "off"):
        raise ValueError(f"length strategy must be A, B or off, not {strategy!r}")
    if not 1 <= low < high:
        raise ValueError("length bounds must meet 1 <= min < max")
