"""lexiframe: labelled-text preparation, features, scoring and evaluation on Spark.

Every operator is a function from DataFrame to DataFrame (or a Column
expression) built from Spark SQL expressions and MLlib stages.  Row order is
never implicit: operators that depend on order take an explicit key column.
"""

from lexiframe.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
__version__ = "0.1.0"
