"""Query plans: every operator bound to tables."""


def load() -> None:
    """Register all queries."""
    from . import arrays, builds, executables, kernels, strings, switches, verdicts, whole  # noqa: F401
