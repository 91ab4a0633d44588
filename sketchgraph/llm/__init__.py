"""Training-data operators: text quality, duplicates, packing, scanning and scoring.

Nothing else in the package imports this subpackage.
"""
