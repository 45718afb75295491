"""All registered queries."""

from __future__ import annotations

from . import (  # noqa: F401
    flow_queries,
    material_queries,
    publish_queries,
    stream_queries,
    task_queries,
    text_queries,
    web_queries,
)
from .registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)
