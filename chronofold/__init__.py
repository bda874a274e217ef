"""chronofold: versioned feature tables and training-data operators on PySpark.

Every operator takes DataFrames and returns a lazy DataFrame. The few iterative ones keep their
rounds in Parquet tables below ``spark.checkpoint.dir`` (see :mod:`chronofold.workspace`).
"""

__version__ = "0.1.0"
