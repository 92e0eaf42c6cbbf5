"""Spark-native analytics for reaction networks, their drawings and the text around them."""

__version__ = "0.1.0"
