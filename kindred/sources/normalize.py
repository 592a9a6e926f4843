"""Hook for an external normaliser that rewrites an APK before it is read."""

from __future__ import annotations

import shutil
import subprocess
from pathlib import Path

#: The passes that have to be applied.
PASSES = ("LocalDcePass", "RegAllocPass")


class NormalizerUnavailable(RuntimeError):
    """The tool is not installed."""


class NormalizerFailed(RuntimeError):
    """The tool ended with an error, or left out a pass."""


def is_available(tool: str = "redex") -> bool:
    return shutil.which(tool) is not None


def normalize(path: str, out_dir: str, tool: str = "redex", passes: tuple[str, ...] = PASSES) -> Path:
    """Runs the tool on the driver and checks that its output names every pass."""
    if not is_available(tool):
        raise NormalizerUnavailable(f"{tool} is not installed")
    out = Path(out_dir) / f"{Path(path).stem}.normalized.apk"
    run = subprocess.run([tool, path, "-o", str(out)], capture_output=True, text=True, check=False)
    if run.returncode:
        raise NormalizerFailed(run.stderr[-500:] or f"{tool} ended with {run.returncode}")
    if absent := [p for p in passes if p not in run.stdout + run.stderr]:
        raise NormalizerFailed(f"passes not applied: {', '.join(absent)}")
    return out
