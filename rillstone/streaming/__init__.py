"""Structured Streaming forms of the learners and sketches."""
