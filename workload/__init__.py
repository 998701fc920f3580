"""Mail tables derived from the test tables, with queries and SQL twins."""

from importlib import import_module

MODULES = ["queries_core", "queries_intel", "queries_reports", "queries_parse", "queries_stream"]


def load_all() -> None:
    """Import every query module, which fills the registry."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
