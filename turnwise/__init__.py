"""Agent-transcript analytics as plain DataFrame operators."""

from turnwise.session import configure, work_dir

__all__ = ["configure", "work_dir"]
