"""packetloom: network-flow analytics as Spark jobs.

Load captures and flow tables, profile and clean them, fold packets into
bidirectional flows, align differently shaped flow sources, sample, balance and
scale them, train and apply Spark ML classifiers, and evaluate any scored table.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with their job, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
