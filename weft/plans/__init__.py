"""Builders of whole plans: pattern, triple and rule queries, and what keeps iterative plans short."""
