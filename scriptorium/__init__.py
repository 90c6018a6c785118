"""scriptorium: a Spark-native pipeline that turns collections of papers into
structured analyses.

Every public function takes and returns a ``DataFrame`` (or a ``Column``);
nothing is collected to the driver.  The language model is outside the
pipeline: requests leave as a table and answers come back as a table.
"""

__version__ = "0.1.0"
