"""Compositions of operators: preparation runs, charts, routing, reports."""
