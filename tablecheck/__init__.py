"""Data-quality checks of loaded tables as Spark jobs."""

from .plans.runner import (
    Mapping,
    Run,
    mapping_metrics,
    run_config,
    run_custom_checks,
    run_mapping,
    run_single_file,
    run_suite,
    violations,
)
from .session import build_session
from .sources.files import SourceError, SourceFiles

__all__ = [
    "Mapping",
    "Run",
    "SourceError",
    "SourceFiles",
    "build_session",
    "mapping_metrics",
    "run_config",
    "run_custom_checks",
    "run_mapping",
    "run_single_file",
    "run_suite",
    "violations",
]
