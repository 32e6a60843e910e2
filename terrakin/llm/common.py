"""Shared plumbing of the training-data operators, from the engine's own."""

from __future__ import annotations

from terrakin.operators.components import components
from terrakin.storage import materialize, scratch, shared_dir

__all__ = ["components", "materialize", "scratch", "shared_dir"]
