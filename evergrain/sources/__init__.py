"""Readers and writers of the evidence formats."""
