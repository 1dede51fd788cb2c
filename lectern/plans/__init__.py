"""Composite queries: browse, search, evaluation, telemetry, accounts."""
