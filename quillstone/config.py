"""Settings: an explicit value, else the environment (a ``.env`` file adds what isn't set), else a TOML file, else a default."""

from __future__ import annotations

import os
import re
import tomllib
from pathlib import Path
from typing import Any

#: Where a connector's folders stand in the environment: NOTES_PATH_1, NOTES_PATH_2 ...
CONNECTORS = {"notes": "NOTES_PATH", "git": "REPO_PATH", "pdf": "PDF_PATH", "image": "IMAGE_PATH"}
#: The file's name and the variable that names another one.
FILE, FILE_VARIABLE = "quillstone.toml", "QUILLSTONE_CONFIG"
#: Defaults of the engine (fixed values), by section and name.
DEFAULTS: dict[tuple[str, str], Any] = {
    ("retrieval", "profile"): "balanced", ("retrieval", "top_k"): 5, ("retrieval", "title_weight"): 0.05, ("retrieval", "min_evidence"): 0.15,
    ("memory", "gap_hours"): 24.0, ("memory", "theta"): 0.80, ("memory", "window_days"): 30.0, ("memory", "ratio"): 0.5, ("memory", "epsilon"): 0.05,
    ("usage", "half_life_days"): 30.0, ("usage", "saturation"): 3.0, ("chat", "turns"): 8,
}


def load_env(path: str = ".env", environment: dict[str, str] | None = None) -> None:
    """Set the variables of a file of ``NAME=value`` lines that aren't set yet; comments and other lines are passed over."""
    environment = os.environ if environment is None else environment
    if not Path(path).is_file():
        return
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        name, sign, value = line.strip().removeprefix("export ").partition("=")
        if sign and not line.lstrip().startswith("#"):
            environment.setdefault(name.strip(), value.strip().strip("\"'"))


class Config:
    """Settings of one environment and file; a file that is missing or can't be read has none."""

    def __init__(self, environment: dict[str, str] | None = None, folder: str = "."):
        self.environment = dict(os.environ if environment is None else environment)
        named = self.environment.get(FILE_VARIABLE, "").strip()
        self.path = Path(named).expanduser() if named else Path(folder) / FILE
        try:
            self.file = tomllib.loads(self.path.read_text(encoding="utf-8"))
        except (OSError, tomllib.TOMLDecodeError):
            self.file = {}

    def get(self, section: str, name: str, explicit: Any = None) -> Any:
        """A setting of the type of its default; a value that isn't of that type counts as unset, a number below or at 0 too."""
        default = DEFAULTS[section, name]
        for value in (explicit, self.environment.get(f"QUILLSTONE_{section}_{name}".upper()), self.file.get(section, {}).get(name) if isinstance(self.file.get(section, {}), dict) else None):
            try:
                found = None if value is None or isinstance(value, bool) else type(default)(value)
            except (TypeError, ValueError):
                continue
            if found and (isinstance(found, str) or found > 0):
                return found
        return default

    def paths(self, connector: str) -> list[str]:
        """Folders of a connector: numbered variables in order, else the file's list."""
        named = re.compile(re.escape(CONNECTORS[connector]) + r"_(\d+)")
        numbered = sorted((int(m[1]), v.strip()) for k, v in self.environment.items() if (m := named.fullmatch(k)) and v.strip())
        listed = self.file.get("connectors", {}).get(connector, []) if isinstance(self.file.get("connectors", {}), dict) else []
        listed = [listed] if isinstance(listed, str) else listed if isinstance(listed, list) else []
        found = [v for _, v in numbered] or [str(v) for v in listed if str(v).strip()]
        return [str(Path(v).expanduser().resolve()) for v in found]
