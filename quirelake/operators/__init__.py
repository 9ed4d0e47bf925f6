"""Relational operators on pages, lines, frames, maps, candidates and jobs."""
