"""File sources; importing this registers their queries."""

from siteward.sources import files, shapes  # noqa: F401
