"""Parameters of locating and tracking, validated once."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass


@dataclass(frozen=True)
class TrackingParams:
    diameter: int
    minmass: float = 0.0
    maxsize: float | None = None
    separation: int | None = None
    noise_size: float = 1.0
    smoothing_size: int | None = None
    threshold: float = 0.0
    invert: bool = False
    percentile: float | None = None
    topn: int | None = None
    preprocess: bool = True
    max_iterations: int = 10
    shift_threshold: float = 0.6
    characterize: bool = False
    filter_close: bool = True
    search_range: float | None = None
    memory: int = 0
    cpu_processed: bool = False
    sig_radius: float | None = None
    bg_radius: float | None = None
    gap_radius: float | None = None
    #: noise_size is the variance of the Gaussian instead of its standard deviation
    variance_mode: bool = False
    #: maxima nearer to the border than so many pixels don't count
    margin: int = 0

    def __post_init__(self) -> None:
        fill = lambda name, value: object.__setattr__(self, name, value if getattr(self, name) is None else getattr(self, name))
        fill("separation", self.diameter + 1)
        fill("smoothing_size", self.diameter)
        if self.bg_radius is not None:
            fill("gap_radius", 0.0)
        if self.diameter < 1 or self.diameter % 2 == 0:
            raise ValueError("diameter has to be odd and positive")
        if self.smoothing_size < 1 or self.smoothing_size % 2 == 0:
            raise ValueError("smoothing_size has to be odd and positive")
        if self.preprocess and self.noise_size >= self.smoothing_size:
            raise ValueError("noise_size has to be below smoothing_size")
        if self.max_iterations < 1:
            raise ValueError("max_iterations has to be 1 at least")
        if self.separation < 1:
            raise ValueError("separation has to be 1 at least")
        if self.bg_radius is not None and self.sig_radius is None:
            raise ValueError("bg_radius needs sig_radius")
        if self.percentile is not None and not 0 <= self.percentile <= 100:
            raise ValueError("percentile has to be from 0 to 100")
        if self.memory < 0:
            raise ValueError("memory can't be negative")
        if self.margin < 0 or (self.maxsize is not None and self.maxsize <= 0):
            raise ValueError("margin can't be negative, and maxsize has to be positive")

    @property
    def radius(self) -> int:
        return self.diameter // 2

    @property
    def variance(self) -> float:
        return self.noise_size if self.variance_mode else self.noise_size**2

    def columns(self) -> list[tuple[str, str]]:
        """Result columns with their types, in order."""
        found = [("frame", "int"), ("mass", "double"), ("y", "double"), ("x", "double")]
        if self.search_range is not None:
            found += [("particle", "bigint")]
        if self.cpu_processed:
            found += [("Rg", "double"), ("ecc", "double"), ("signal", "double")]
        if self.sig_radius is not None:
            found += [("raw_mass", "double")]
        if self.bg_radius is not None:
            found += [("raw_bg_median", "double"), ("raw_mass_corrected", "double")]
        if self.characterize:
            found += [("Rg_gpu", "double"), ("raw_mass_gpu", "double"), ("signal_gpu", "double"), ("ecc_gpu", "double")]
        return found


@dataclass(frozen=True)
class LabParams:
    """Parameters of the lab pipeline: lip_* are squared radii, tracking_time is seconds a frame."""

    object_size: int = 9
    sep: int = 5
    mean_multiplier: float = 0.8
    lip_int_size: float = 9
    lip_BG_size: float = 60
    gap_size: float = 0
    memory: int = 1
    search_range: float = 5
    duration_filter: int = 20
    tracking_time: float = 0.036
    pixel_size: float = 0.18333
    save_path: str | None = None
    exp_types: tuple[str, ...] = ()
    exp_type_folders: tuple[str, ...] = ()
    #: scale twice and divide lags by tracking_time, as recorded results of earlier runs were
    reference_units: bool = False

    @classmethod
    def load(cls, path: str | None = None, **own) -> LabParams:
        """Defaults, then the file's values, then keyword arguments; unknown keys of a file are ignored."""
        names = {f.name for f in dataclasses.fields(cls)}
        if unknown := set(own) - names:
            raise ValueError(f"no such parameters: {sorted(unknown)}")
        found = {k: v for k, v in (read_yaml(path) if path else {}).items() if k in names}
        merged = found | own
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in merged.items()})


def _scalar(text: str):
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return {"true": True, "false": False, "null": None, "~": None, "": None}.get(text.lower(), text)


def read_yaml(path: str) -> dict:
    """Flat mappings of scalars and lists of scalars, which is all that parameter files hold."""
    found: dict = {}
    last = None
    with open(path, encoding="utf-8") as lines:
        for line in lines:
            bare = line.split(" #")[0].rstrip()
            if not bare.strip() or bare.lstrip().startswith("#"):
                continue
            if bare.lstrip().startswith("- "):
                if not isinstance(found.get(last), list):
                    found[last] = []
                found[last].append(_scalar(bare.lstrip()[2:]))
                continue
            last, _, value = bare.partition(":")
            last, value = last.strip(), value.strip()
            found[last] = [_scalar(x) for x in value[1:-1].split(",") if x.strip()] if value.startswith("[") else _scalar(value)
    return found


def write_yaml(path: str, values: dict) -> None:
    with open(path, "w", encoding="utf-8") as out:
        for k, v in values.items():
            out.write(f"{k}:\n" + "".join(f"- {x}\n" for x in v) if isinstance(v, (list, tuple)) else f"{k}: {'null' if v is None else v}\n")


def update_yaml(path: str, **values) -> None:
    """Write new values of some keys into a parameter file, in place: other lines, comments too, stay as they are."""
    with open(path, encoding="utf-8") as source:
        lines = source.read().split("\n")
    missing = dict(values)
    for i, line in enumerate(lines):
        name, colon, rest = line.partition(":")
        if colon and name.strip() in missing:
            comment = rest[rest.index(" #") :] if " #" in rest else ""
            lines[i] = f"{name}: {missing.pop(name.strip())}{comment}"
    if missing:
        raise ValueError(f"{path} has no {sorted(missing)}")
    with open(path, "w", encoding="utf-8") as out:
        out.write("\n".join(lines))


def update_mm_and_sep(path: str, mean_multiplier: float, sep: int) -> None:
    update_yaml(path, mean_multiplier=mean_multiplier, sep=sep)
