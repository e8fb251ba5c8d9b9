"""Whole studies as one plan; importing this registers their queries."""

from siteward.plans import exposure  # noqa: F401
