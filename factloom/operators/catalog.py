"""Analyst tools by name: what each takes and the function that does it."""

from __future__ import annotations

from factloom.operators import answers, conflicts, graph, lifecycle, search, series

CATALOG = {
    "calculate_growth": (("points",), series.latest_growth),
    "compare_periods": (("points", "old", "new"), series.compare_periods),
    "rank_entities": (("points", "attribute", "top"), series.rank_entities),
    "entity_summary": (("facts",), graph.footprint),
    "get_evidence": (("facts", "top"), graph.evidence_list),
    "find_conflicts": (("facts",), conflicts.radar),
    "compare_documents": (("facts", "left", "right"), lifecycle.compare_documents),
    "search_documents": (("docs", "questions", "k"), search.bm25),
    "get_facts": (("questions", "facts", "most"), answers.fact_lookup),
}
