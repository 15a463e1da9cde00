"""Whole jobs made of operators: dataset building, sweeps and experiments."""
