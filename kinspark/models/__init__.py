"""Estimators: fit, predict, evaluate, save and load."""
