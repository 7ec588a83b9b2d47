"""recordweave: a Spark-native engine for operational event records.

Raw lines become structured rows, rows are reshaped, aggregated into metrics and
routed to sinks.  Everything is declared as DataFrame expressions; the few
sequential semantics live in keyed stateful operators.
"""

import sys

from pyspark import cloudpickle

# Functions and processors that run on executors travel by value: executors need no copy of this library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
