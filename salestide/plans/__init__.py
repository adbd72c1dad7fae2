"""Named queries over the driver's tables, one module per operator group."""

from importlib import import_module

_MODULES = [
    "cleaning", "periods", "profiling", "kpis", "correlation", "series", "products",
    "clients", "client360", "geography", "currency", "anomalies", "behaviour", "clustering",
    "forecasting", "sheets", "recipes", "files", "stated",
]


def load_queries() -> None:
    for name in _MODULES:
        import_module(f"salestide.plans.{name}_queries")
