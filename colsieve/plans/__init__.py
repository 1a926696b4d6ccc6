"""Experiment grids, result statistics, feature preparation, tensor trains, and the registered queries."""
