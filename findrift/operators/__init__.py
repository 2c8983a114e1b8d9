"""DataFrame operators: occurrence counts, blocking, scoring, assignment, decisions, evaluation."""
