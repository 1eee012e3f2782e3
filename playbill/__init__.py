"""playbill: event-listing analytics as Spark DataFrame functions.

Every public function takes and returns DataFrames (or Columns) and leaves
physical planning to Catalyst.  See README.md for the map of modules.
"""

__version__ = "0.1.0"
