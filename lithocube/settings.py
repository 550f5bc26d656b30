"""Settings of a run: a typed schema of an INI file's sections. What the schema doesn't know is an error."""

from __future__ import annotations

import configparser
import io
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field


def _switch(text: str) -> bool:
    if text.lower() in ("1", "true", "yes", "on"):
        return True
    if text.lower() in ("0", "false", "no", "off"):
        return False
    raise ValueError("true or false")


def _numbers(text: str) -> tuple[float, ...]:
    return tuple(float(x) for x in text.split(","))


def _one_of(*names: str) -> Callable[[str], str]:
    def kind(text: str) -> str:
        if text.lower() not in names:
            raise ValueError(" or ".join(names))
        return text.lower()

    return kind


#: Sections and keys of the settings file, with their types and what holds where they are left out.
SCHEMA: dict[str, dict[str, tuple[Callable, object]]] = {
    "Paths": {"data_dir": (str, None), "output_dir": (str, None), "grid_nc": (str, None)},
    "Dataset": {
        "grid_metrics_file": (str, None),
        "station_coords_file": (str, "mlcw_station_coordinates.csv"),
        "csv_dir_name": (str, "CSV_files"),
        "csv_name_pattern": (str, "{name}_insar_mlcw.csv"),
        "x_col": (str, "X_TWD97"),
        "y_col": (str, "Y_TWD97"),
        "station_name_col": (str, "Ename"),
        "depth_col": (str, "Depth"),
        "month_col_prefix": (str, "Month_"),
        "insar_surface_depth": (int, 0),
        "min_insar_fraction": (float, 0.5),
        "displacement_var": (str, "displacement"),
        "nc_depth_dim": (str, "Depth"),
        "x_dim": (str, "X"),
        "y_dim": (str, "Y"),
        "time_dim": (str, "Time"),
        "time_label_var": (str, "month_label"),
        "crs": (str, None),
    },
    "Inversion": {
        "sigma_insar": (float, 3.0),
        "sigma_well": (float, 1.0),
        "weighted": (_switch, False),
        "solver": (_one_of("joint", "independent", "cvxpy"), "joint"),
        "month_start": (int, 0),
        "month_end": (int, None),
        "lam": (float, None),
        "lam_t": (float, None),
    },
    "Tuning": {
        "fixed_lam": (float, None),
        "fixed_lam_t": (float, None),
        "lam_candidates": (_numbers, None),
        "lam_t_candidates": (_numbers, None),
        "n_trials": (int, None),
        "prev_best_params": (str, None),
    },
    "SpatialInterpolation": {"method": (_one_of("gp", "kriging"), "gp")},
    "Kriging": {"n_trials": (int, 50), "n_splits": (int, 5), "max_anisotropy": (float, 3.0), "verbose": (_switch, False)},
    "GP": {
        "n_restarts": (int, None),
        "std_threshold": (float, 0.3),
        "gp_length_scale": (float, None),
        "gp_length_scale_min": (float, None),
        "gp_length_scale_max": (float, None),
        "gp_noise_level": (float, None),
        "gp_noise_level_min": (float, None),
        "gp_noise_level_max": (float, None),
        "gp_mode": (_one_of("isotropic", "anisotropic"), "isotropic"),
        "max_anisotropy": (float, 10.0),
        "angle_search": (_one_of("bounded", "global"), "bounded"),
        "angle_min": (float, 0.0),
        "angle_max": (float, 180.0),
    },
    "CV": {"run_spatial_cv": (_switch, True), "run_temporal_cv": (_switch, True), "n_gp_restarts": (int, None)},
    "Report": {"no_plots": (_switch, False), "make_plots": (_switch, False), "plot_station_timeseries": (_switch, False)},
}

#: Known keys without an effect: nothing is drawn or printed here, the tuning goes through its whole grid, searches have no restarts, and a
#: rotated search always looks at all of its angles.
WITHOUT_EFFECT = {("Tuning", "n_trials"), ("Tuning", "prev_best_params"), ("Kriging", "verbose"), ("GP", "n_restarts"), ("GP", "angle_search"), ("CV", "n_gp_restarts"), ("Dataset", "crs"), ("Dataset", "grid_metrics_file")} | {("Report", k) for k in SCHEMA["Report"]}


@dataclass(frozen=True)
class RunConfig:
    """Settings by section and key, each of its type; keys that are left out or blank have their defaults."""

    sections: Mapping[str, Mapping[str, object]] = field(default_factory=lambda: {s: {k: default for k, (_, default) in keys.items()} for s, keys in SCHEMA.items()})

    @classmethod
    def parse(cls, text: str) -> RunConfig:
        parser = configparser.ConfigParser(interpolation=None)
        parser.read_file(io.StringIO(text))
        found = {s: {k: default for k, (_, default) in keys.items()} for s, keys in SCHEMA.items()}
        for section in parser.sections():
            if section not in SCHEMA:
                raise ValueError(f"unknown section [{section}]")
            for key, value in parser[section].items():
                if key not in SCHEMA[section]:
                    raise ValueError(f"unknown key {key} in [{section}]")
                if value.strip():
                    try:
                        found[section][key] = SCHEMA[section][key][0](value.strip())
                    except ValueError as e:
                        raise ValueError(f"{key} in [{section}]: {value.strip()!r} isn't {e}") from e
        return cls(found)

    def __getitem__(self, name: tuple[str, str]) -> object:
        return self.sections[name[0]][name[1]]

    @property
    def solver(self) -> str:
        return self["Inversion", "solver"]

    @property
    def months(self) -> tuple[int, int | None]:
        return self["Inversion", "month_start"], self["Inversion", "month_end"]

    @property
    def smoothing(self) -> tuple[float | None, float | None]:
        """(lam, lam_t): preset values first, then fixed ones of the tuning section."""
        preset = self["Inversion", "lam"], self["Inversion", "lam_t"]
        return preset if None not in preset else (self["Tuning", "fixed_lam"], self["Tuning", "fixed_lam_t"])

    @property
    def sigma(self) -> tuple[float, float]:
        """Spreads of surface and wells; both 1 unless data are to be weighted by them (the coupled solver always weights)."""
        return (self["Inversion", "sigma_insar"], self["Inversion", "sigma_well"]) if self["Inversion", "weighted"] or self.solver == "cvxpy" else (1.0, 1.0)

    @property
    def engine(self) -> dict[str, object]:
        """What the interpolation's functions take: engine, trials, most_ratio, splits and bounds."""
        if self["SpatialInterpolation", "method"] == "kriging":
            return {"engine": "kriging", "trials": self["Kriging", "n_trials"], "most_ratio": self["Kriging", "max_anisotropy"], "splits": self["Kriging", "n_splits"], "bounds": None}
        names = ("gp_length_scale", "gp_length_scale_min", "gp_length_scale_max", "gp_noise_level", "gp_noise_level_min", "gp_noise_level_max", "angle_min", "angle_max")
        engine = "gp" if self["GP", "gp_mode"] == "isotropic" else "rotated"
        return {"engine": engine, "trials": None, "most_ratio": self["GP", "max_anisotropy"], "splits": 5, "bounds": {k.removeprefix("gp_"): self["GP", k] for k in names}}
