"""Settings: built-in values, a user's YAML file over them, and single values over both."""

from __future__ import annotations

from copy import deepcopy
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any


@dataclass
class Responder:
    """A model that answers prompts, and what it can take."""

    provider: str
    model: str
    base_url: str | None = None
    api_key_env: str | None = None
    max_tokens: int = 4096
    max_image_side: int = 1568
    max_images_per_call: int = 8
    bbox_format: str = "xyxy_1000"
    timeout: float = 180.0
    extra: dict[str, Any] = field(default_factory=dict)


#: What holds where a user sets nothing.
DEFAULTS: dict[str, Any] = {
    "default_vlm": "auto",
    "auto_preference": [],
    "agent_vlms": {},
    "vlms": {"mock": {"provider": "mock", "model": "mock"}},
    "orchestrator": {"mode": "pipeline", "max_steps": 20, "stop_if_not_drawing": False},
    "preprocess": {"max_side": 1800, "crop_page": True, "orientation": "auto", "remove_rules": True},
    "shapes": {"detector": "cv", "weights": None, "yolo_conf": 0.35, "min_shape_scale": 7.0, "gap_close_scale": 2.0, "fit_threshold": 0.86, "keep_subregions": False, "max_merge": 3},
    "connections": {"min_line_scale": 10.0, "heavy_ratio": 1.6, "attach_scale": 3.0},
    "text": {"near_scale": 2.5, "ocr": "vlm", "batch_size": 6, "crop_pad": 6, "max_items": 150},
    "vlm_analyst": {"enabled": True},
    "verifier": {"enabled": True, "max_rounds": 2},
}
#: Options of the command line that stand for one setting each.
OPTIONS = {"vlm": "default_vlm", "mode": "orchestrator.mode", "orientation": "preprocess.orientation", "detector": "shapes.detector", "weights": "shapes.weights", "ocr": "text.ocr"}


def merged(base: dict, over: dict | None, within: str = "") -> dict:
    """``base`` with ``over`` laid on it, tables within tables too.

    A responder that ``over`` gives another provider or address replaces the old one as a whole, so that none of its other
    settings linger.
    """
    out = deepcopy(base)
    for key, value in (over or {}).items():
        old = out.get(key)
        both = isinstance(old, dict) and isinstance(value, dict)
        if both and within == "vlms" and any(k in value and value[k] != old.get(k) for k in ("provider", "base_url")):
            both = False
        out[key] = merged(old, value, key) if both else deepcopy(value)
    return out


def put(settings: dict, path: str, value: Any) -> None:
    """Set ``a.b.c``, making the tables on the way."""
    *way, last = path.split(".")
    for key in way:
        settings = settings.setdefault(key, {})
    settings[last] = value


@dataclass(frozen=True)
class Settings:
    """All settings as one table; sections by attribute."""

    values: dict[str, Any]

    def __getattr__(self, name: str) -> Any:
        try:
            return self.values[name]
        except KeyError:
            raise AttributeError(name) from None

    def responder_for(self, agent: str) -> str:
        return self.values["agent_vlms"].get(agent, self.values["default_vlm"])

    def responders(self) -> dict[str, Responder]:
        known = {f.name for f in fields(Responder)}
        return {name: Responder(**{k: v for k, v in r.items() if k in known}) for name, r in self.values["vlms"].items()}


def load(path: str | Path | None = None, over: dict | None = None) -> Settings:
    """Built-in settings, then a YAML file, then ``over``."""
    values = DEFAULTS
    if path:
        import yaml

        values = merged(values, yaml.safe_load(Path(path).read_text(encoding="utf-8")))
    return Settings(merged(values, over))


def from_options(options: dict[str, Any]) -> dict:
    """Settings that command-line options ask for: named ones, ``agent_vlm`` and ``set`` as lists of key=value, switches."""
    import yaml

    out: dict = {}
    for name, path in OPTIONS.items():
        if options.get(name) is not None:
            put(out, path, options[name])
    if options.get("no_vlm"):
        out["default_vlm"] = "none"
    if options.get("no_verify"):
        put(out, "verifier.enabled", False)
    for item in options.get("agent_vlm") or []:
        agent, _, spec = item.partition("=")
        if not spec:
            raise ValueError(f"agent=responder expected, not {item!r}")
        out.setdefault("agent_vlms", {})[agent.strip()] = spec.strip()
    for item in options.get("set") or []:
        path, _, value = item.partition("=")
        put(out, path.strip(), yaml.safe_load(value))
    return out


def as_yaml(settings: Settings) -> str:
    import yaml

    return yaml.safe_dump(settings.values, sort_keys=False)


