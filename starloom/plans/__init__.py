"""Pipelines and named queries made from the operators."""
