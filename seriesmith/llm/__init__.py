"""Operators for training-data pipelines; one module per operator, queries registered in ``queries``."""
