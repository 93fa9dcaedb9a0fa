"""The registered queries of the document-fact operators, and their SQL."""

from docfacts.plans import confirm_queries, field_queries, grid_queries, layout_queries, record_queries

PARTS = [field_queries, record_queries, grid_queries, layout_queries, confirm_queries]
QUERIES = {name: f for part in PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
FLAGSHIP = "grade_histogram"
