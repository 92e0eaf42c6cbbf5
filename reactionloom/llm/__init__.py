"""Operators that prepare text and entity data for training. Nothing else in the library imports this subpackage."""
