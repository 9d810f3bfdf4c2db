"""Readers and writers: case sets, result documents, run state, reports."""
