"""Query registry: names bound to a Spark callable and, where SQL can express it, DuckDB SQL."""

from importlib import import_module

#: Modules that register queries when imported.
MODULES = ("catalog", "statistics", "texts", "similar", "series", "telemetry", "lines", "formats", "tables", "stored", "timed", "looked_up")


def load_all() -> None:
    for name in MODULES:
        import_module(f"silt.plans.{name}")
