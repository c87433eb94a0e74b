"""Training-data operators: cleaning, language, near-duplicates, personal data, decontamination, language
model, classifiers, mixing and line de-duplication.  Nothing outside this folder imports it.

Functions that run in tasks are sent by value, so executors need no copy of this folder on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
