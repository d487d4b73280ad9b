"""The run's settings: a flat YAML file of scalars."""

from __future__ import annotations

from dataclasses import MISSING, dataclass, fields


@dataclass
class Config:
    epsilon_arcsec: float
    min_detections: int
    max_detections: int
    min_duration: float
    min_nites: int
    spice_path: str
    detection_catalog: str
    initial_conditions_file: str
    reference_epoch: float
    orbit_reference_plane: str
    ic_type: str
    ic_origin: str
    output_path: str
    clusters_filename: str


def parse(text: str) -> dict[str, object]:
    """Keys and scalar values of a flat YAML text: quoted or plain strings, numbers, comments."""
    out: dict[str, object] = {}
    for n, raw in enumerate(text.splitlines(), 1):
        line = raw.strip()
        if not line or line.startswith(("#", "---")):
            continue
        key, colon, value = line.partition(":")
        if not colon or (value and not value.startswith((" ", "\t"))):
            raise ValueError(f"line {n} is not 'key: value': {raw!r}")
        value = value.strip()
        if value[:1] in "\"'" and value:
            end = value.find(value[0], 1)
            if end < 0:
                raise ValueError(f"line {n} has an open quote: {raw!r}")
            out[key.strip()] = value[1:end]
            continue
        value = value.split(" #")[0].strip()
        for kind in (int, float):
            try:
                out[key.strip()] = kind(value)
                break
            except ValueError:
                continue
        else:
            out[key.strip()] = value
    return out


def of(text: str) -> Config:
    """All keys are required; unknown ones are left alone."""
    found = parse(text)
    missing = [f.name for f in fields(Config) if f.name not in found and f.default is MISSING]
    if missing:
        raise ValueError(f"the settings lack {', '.join(missing)}")
    kinds = {"float": float, "int": int, "str": str}
    return Config(**{f.name: kinds[f.type](found[f.name]) for f in fields(Config)})


def load(path: str) -> Config:
    with open(path, encoding="utf-8") as f:
        return of(f.read())
