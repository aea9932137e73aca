"""pulseforge: Spark-native analytics for multichannel time series and event tables.

Its Python code travels to the executors inside the tasks, so executors need not have this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
