"""Operators for preparing training data. Nothing else in rillspark imports this subpackage."""
