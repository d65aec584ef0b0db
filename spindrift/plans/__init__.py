"""Searches and answers composed of operators, and the catalogue of queries."""
