"""Whole jobs: the pipelines and one registered query per operator."""

from importlib import import_module

SECTIONS = ["intake", "cleaning", "modelling", "rollups", "places", "detection", "answers"]


def load_all() -> dict:
    """Import every section and return the registry of queries."""
    for section in SECTIONS:
        import_module(f"ampledger.plans.{section}")
    return import_module("ampledger.plans.registry").REGISTRY
