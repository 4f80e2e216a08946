"""Compositions of operators: recommendations, evaluation, reports, training."""
