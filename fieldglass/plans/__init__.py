"""Registered queries over the given tables, each with a SQL twin where one can be written."""

from fieldglass.plans.registry import REGISTRY, Tables, register

__all__ = ["REGISTRY", "Tables", "register", "load_all"]

MODULES = ("profiling", "traffic", "evaluation", "search", "text", "graphs", "sheets", "layouts", "stores")


def load_all() -> dict:
    from importlib import import_module

    for module in MODULES:
        import_module(f"fieldglass.plans.{module}")
    return REGISTRY
