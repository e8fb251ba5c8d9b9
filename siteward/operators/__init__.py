"""Operators of the study; importing this registers their queries."""

from siteward.operators import admission, behaviour, checks, field, flows, geometry, graph, network, relations, results, samplers, sinks, tables  # noqa: F401
