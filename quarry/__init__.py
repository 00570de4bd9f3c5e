"""quarry: document evidence, retrieval evaluation and training-data preparation on PySpark."""
