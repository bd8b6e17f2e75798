"""Relational and iterative operators on count tables, graphs, scores and fits."""
