"""Every registered query of the track operators."""

from importlib import import_module

from .base import REGISTRY

for _name in ("geometry", "tracks", "tags", "samples", "predictions", "evaluation", "pixels", "tables", "streams", "models"):
    import_module(f"{__package__}.{_name}")

__all__ = ["REGISTRY"]
