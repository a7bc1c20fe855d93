"""starfold: fold a star of one-to-many tables into one feature row per entity, then score it.

Layout
    sources    CSV/Parquet readers with declared types, scored-row and table sinks
    functions  column expressions: cleaning, null fills, aggregate builders
    operators  frame-level operators: scaling, encoding, blocks, joins, profiles, splits
    models     boosted trees on pyspark.ml: fit, score, importance, stacking
    plans      the feature recipes built from the above
    queries    the same operators bound to the test tables, each with its SQL twin
"""
