"""Whole jobs: prepare a dataset, compare two models."""
