"""Relational operators: schema induction, extraction, verification, graphs, communities, retrieval, alignment."""
