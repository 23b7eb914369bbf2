"""Readers and writers of assembly graphs, sequences, alignments, pair lists and reports."""
