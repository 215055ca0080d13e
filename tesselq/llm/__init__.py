"""Operators of a training-data pipeline; nothing else in tesselq imports this subpackage."""
