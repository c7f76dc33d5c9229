"""auralake: a PySpark-native engine for transcripts, charts and media catalogs.

Operators are functions from DataFrame to DataFrame; nothing is collected to the
driver unless its size has a stated bound.
"""

__version__ = "0.1.0"
