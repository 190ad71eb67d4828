"""Visitor analytics and page personalisation as Spark DataFrame plans."""

from tailorspark.session import get_session, scratch_dir

__all__ = ["get_session", "scratch_dir"]
