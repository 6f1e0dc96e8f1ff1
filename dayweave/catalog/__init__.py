"""Registered queries over the given tables, with their oracle SQL side by side."""

from dayweave.catalog.base import QUERIES, oracles  # noqa: F401
from dayweave.catalog import capture, documents, finding, inputs, operations, relational, sessions, streams, texts, topics, vectors  # noqa: F401
