"""Lantern: a PySpark-native hybrid retrieval engine for source trees and document tables."""

__version__ = "0.1.0"
