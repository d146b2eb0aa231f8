"""Whole preparations of a data set."""
