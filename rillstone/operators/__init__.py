"""Sketches, top-k, pairs and learners."""
