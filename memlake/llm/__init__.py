"""Operators for preparing training data. Nothing else in memlake imports this subpackage."""
