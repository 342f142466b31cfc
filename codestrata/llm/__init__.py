"""Operators of a training-data pipeline: filters, classifiers, joins, searches and packing.

Every operator takes DataFrames and parameters and returns a DataFrame; `queries` applies each to
its table.  What runs inside tasks is sent along with the job, so executors need no copy of this
package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
