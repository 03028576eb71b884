"""Layered INI settings with typed getters, and duration strings (S16, F21, section 2.14)."""

from __future__ import annotations

import configparser
import datetime as dt
import warnings

#: Defaults that change results.
DEFAULTS = {
    "general": {"src_path": "", "src_recur": "false"},
    "database": {"split_symbol": "@@", "undefined_host": "false", "path": "warehouse/log"},
    "log_template": {"variable_symbol": "**", "lt_alg": "shiso", "ltgroup_alg": "shiso", "post_alg": "host,dummy", "sym_ignore": "true"},
    "log_template_shiso": {"ltgen_threshold": "0.9", "ltgen_max_child": "4", "ltgroup_threshold": "0.3", "ltgroup_distance": "0.85", "ngram_length": "3"},
    "log_template_va": {"threshold": "0.6"},
    "dag": {"event_gid": "ltgid", "area": "all", "unit_term": "30h", "unit_diff": "24h", "stat_bin": "10s", "stat_bin_overlap": "0s", "ci_func": "gsq", "skeleton_method": "default", "skeleton_depth": "-1", "threshold": "0.01", "usefilter": "false"},
    "filter": {"action": "replace+linear", "dt_cond": "1d_1s,7d_1m", "periodic_count": "5", "periodic_term": "6h", "threshold_spec": "0.4", "threshold_eval": "0.1", "threshold_restore": "0.5", "linear_count": "10", "linear_binsize": "10s", "linear_threshold": "0.5", "self_corr_th": "0.5", "self_corr_diff": "1h,1d", "self_corr_bin": "1m"},
    "changepoint": {"cf_bin": "1m", "cf_r": "0.001", "cf_order": "1", "cf_smooth": "5"},
    "visual": {"edge_filter_method": "count_ighost", "edge_filter_th": "0.05"},
    "search": {"method": "log", "dag_ig_direction": "true", "dag_weight": "true"},
}

_UNITS = (("s", 1), ("m", 60), ("h", 3600), ("d", 86400), ("w", 604800))


def seconds(text: str) -> int:
    """``10s``, ``5m``, ``6h``, ``1d``, ``2w`` as seconds."""
    text = text.strip()
    for letter, size in _UNITS:
        if letter in text:
            return int(text.replace(letter, "")) * size
    raise ValueError(f"no duration: {text!r}")


class Settings:
    """Defaults under a file under given values."""

    def __init__(self, path: str | None = None, **over: dict[str, str]):
        self._ini = configparser.ConfigParser(interpolation=None)
        self._ini.read_dict(DEFAULTS)
        if path:
            with open(path, encoding="utf-8") as f:
                extra = configparser.ConfigParser(interpolation=None)
                extra.read_file(f)
            self.update({s: dict(extra.items(s)) for s in extra.sections()})
        self.update(over)

    def update(self, values: dict[str, dict[str, str]]) -> None:
        """Override known options; an unknown one is kept with a warning."""
        for section, options in values.items():
            for name, value in options.items():
                if not self._ini.has_option(section, name):
                    warnings.warn(f"unknown option {section}.{name}", stacklevel=2)
                    if not self._ini.has_section(section):
                        self._ini.add_section(section)
                self._ini.set(section, name, str(value))

    def merge(self, values: dict[str, dict[str, str]]) -> None:
        """Add only what isn't there."""
        for section, options in values.items():
            if not self._ini.has_section(section):
                self._ini.add_section(section)
            for name, value in options.items():
                if not self._ini.has_option(section, name):
                    self._ini.set(section, name, str(value))

    def get(self, section: str, name: str) -> str:
        return self._ini.get(section, name)

    def int(self, section: str, name: str) -> int:
        return self._ini.getint(section, name)

    def float(self, section: str, name: str) -> float:
        return self._ini.getfloat(section, name)

    def bool(self, section: str, name: str) -> bool:
        return self._ini.getboolean(section, name)

    def list(self, section: str, name: str) -> list[str]:
        return [x.strip() for x in self.get(section, name).split(",") if x.strip()]

    def tuple(self, section: str, name: str) -> tuple[str, ...]:
        return tuple(self.list(section, name))

    def dur(self, section: str, name: str) -> int:
        return seconds(self.get(section, name))

    def dt(self, section: str, name: str) -> dt.datetime:
        return dt.datetime.strptime(self.get(section, name), "%Y-%m-%d %H:%M:%S")

    def term(self, section: str, name: str) -> tuple[dt.datetime, dt.datetime]:
        a, b = self.list(section, name)
        return dt.datetime.strptime(a, "%Y-%m-%d %H:%M:%S"), dt.datetime.strptime(b, "%Y-%m-%d %H:%M:%S")
