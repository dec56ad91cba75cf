"""Business-table analysis, retrieval and report text as Spark DataFrame functions.

Every operator is a plain function from DataFrame to DataFrame, so calls chain
with ``df.transform``.  Nothing here keeps state, and nothing collects a table
to the driver.
"""

import sys

from pyspark import cloudpickle

from insightspark.errors import DataIngestionError, DocumentIngestionError

# The few Python functions that run in tasks travel with the job, so executors
# need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["DataIngestionError", "DocumentIngestionError"]
