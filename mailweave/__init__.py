"""mailweave: message-archive analytics as plain Spark DataFrame jobs.

Every public function takes DataFrames (or Columns) and returns DataFrames
(or Columns); nothing collects rows to the driver except small, bounded
report assembly.
"""

__version__ = "0.1.0"
