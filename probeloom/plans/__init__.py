"""Compositions of operators: cohort, search, study and report plans."""
