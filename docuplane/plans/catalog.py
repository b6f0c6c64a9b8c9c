"""All query modules outside the llm subpackage."""

from __future__ import annotations

from docuplane.plans import core, jobs, meta, search, streams

MODULES = [core, meta, search, jobs, streams]


def flagship(spark, d):
    """The query that entry() runs: a filtered, ranked page over the live index rows."""
    return search.search_page(spark, d)
