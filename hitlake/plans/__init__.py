"""Registered queries."""

from . import clusters, features, flagging, joined, more, scoring, shown, tables  # noqa: F401
