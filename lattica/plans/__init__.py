"""Whole analyses: configuration, the staged model, the layered map and its figure."""
