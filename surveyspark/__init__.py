"""Survey analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

from surveyspark.params import SurveyParams, round_2016, round_2024

# Functions run by Python workers travel with their task, so executors do not
# need this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["SurveyParams", "round_2016", "round_2024"]
