"""Training-data operators: scoring, extraction, de-duplication, filtering, mixing and token output.

Nothing else in the library imports this subpackage.
"""
