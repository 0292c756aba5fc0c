"""Column functions. The Arrow functions travel to executors by value, so a cluster does
not need this package installed on its workers."""

from pyspark import cloudpickle

from dialogue_lake.functions import similarity, text

for _module in (similarity, text):
    cloudpickle.register_pickle_by_value(_module)
