"""Derived inputs, the registered queries, and the page pipeline."""
