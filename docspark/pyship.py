"""Makes Python functions of this package travel inside the serialized task.

Executors of a cluster need not have the package installed: cloudpickle sends
the registered modules by value instead of by import path.
"""

from pyspark import cloudpickle


def ship(module) -> None:
    cloudpickle.register_pickle_by_value(module)
