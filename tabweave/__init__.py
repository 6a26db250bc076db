"""tabweave: leak-free tabular features, exact ranking metrics and model blending on Spark."""

from tabweave.session import build_session, materialize, workspace

__all__ = ["build_session", "materialize", "workspace"]
