"""helixframe: sequence-corpus, embedding and model-evaluation analytics on PySpark.

Every operator takes DataFrames and returns a DataFrame. Nothing here starts a
Spark job unless its docstring says so (writers, streaming runs and the
``pyspark.ml`` estimators do).
"""

__version__ = "0.1.0"
