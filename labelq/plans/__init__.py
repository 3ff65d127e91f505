"""Analyses composed of operators: result tables, rankings, experiments."""
