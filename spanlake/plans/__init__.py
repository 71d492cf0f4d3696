"""Composed jobs: the operators chained into the stages a user runs."""
