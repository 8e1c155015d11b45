"""DataFrame operators: scoring, joins, history, models and reports."""
