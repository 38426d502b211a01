"""Curate, prepare, score and evaluate labelled tables on Spark."""
