"""Where the outputs of an experiment go."""

from __future__ import annotations

STAGES, VERSIONS = (3, 4, 5), (1, 2, 3)


def output_folder(stage: int, version: int, root: str = "data/processed") -> str:
    """A folder per stage and version; the root itself for any other."""
    return f"{root}/Stage{stage}/Version{version}" if stage in STAGES and version in VERSIONS else root


def output_name(kind: str, min_support: float, min_confidence: float | None = None) -> str:
    return f"{kind}_output_minSup_{min_support}" + (f"_minConf_{min_confidence}" if min_confidence is not None else "") + ".txt"
