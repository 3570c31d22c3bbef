"""beaconflow: Spark-native analytics for vehicle-to-vehicle safety messages.

Every operator is a ``DataFrame -> DataFrame`` function (usable with
``df.transform``) or a Spark ML stage.  Sub-packages:

- ``sources``   readers, contracts, sinks
- ``functions`` column expressions and distributed rank helpers
- ``operators`` profiling, labels, splits, sequence features, scaling, evaluation
- ``plans``     model training, search loops, scoring and the query catalog
- ``streaming`` Structured Streaming variants of features and scoring
"""

__version__ = "0.1.0"
