"""Import every module that registers queries."""

from tidemark.operators import aggregates, dictionary, edits, evaluation, geo, graph, joins, lint, markup, names, parsers, predicates, refresh, repeats, retention, search, similar, sinks, stems, text, text_rules, windows  # noqa: F401
from tidemark.streaming import rollups  # noqa: F401
