"""Registered query plans, one module per area."""

from importlib import import_module

MODULES = ["event_queries", "hist_queries", "lhe_queries", "sample_queries", "particle_queries", "ml_queries", "inference_queries", "stream_queries"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"sparkcollide.plans.{name}")
