"""All registered queries."""

from __future__ import annotations

from docflow.catalog import chunking, evaluation, layout, observability, retrieval, streaming, tables, text

ENTRIES = {
    **retrieval.ENTRIES,
    **tables.ENTRIES,
    **text.ENTRIES,
    **chunking.ENTRIES,
    **layout.ENTRIES,
    **observability.ENTRIES,
    **evaluation.ENTRIES,
    **streaming.ENTRIES,
}
