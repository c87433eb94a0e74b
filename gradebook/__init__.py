"""gradebook: Spark-native evaluation analytics for multiple-choice answer sheets.

Every public operator takes and returns a DataFrame; nothing is collected to the
driver inside an operator.  Sub-packages:

* ``sources``   - table loaders, fixture views derived from the driver tables, sheet/JSON/XML readers
* ``functions`` - Column-level helpers (text normalisation, Wilson bounds, p-value kernels, seeded draws)
* ``operators`` - grading, summaries, agreement, tests, resampling, judging, corpus and prompt jobs
* ``plans``     - the named query catalogue (Spark builders + DuckDB oracle SQL)
* ``streaming`` - Structured Streaming form of the landing job

Functions that run in tasks are sent by value, so executors need no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.2.0"
