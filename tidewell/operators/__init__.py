"""DataFrame operators: aggregation, joins, windows, alerts, calendars, scores and models."""
