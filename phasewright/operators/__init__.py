"""Dataflow operators; each module is one stage of the graph pipeline."""
