"""Find and rank items related to a seed set over a citation graph, on Spark."""
