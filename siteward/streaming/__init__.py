"""Structured Streaming forms; importing this registers their queries."""

from siteward.streaming import events  # noqa: F401
