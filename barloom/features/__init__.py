"""Feature catalogue: importing this package registers every built-in feature."""

from . import columns, recursive  # noqa: F401
from .registry import FEATURES, FeatureSpec, register, register_frame

__all__ = ["FEATURES", "FeatureSpec", "register", "register_frame"]
