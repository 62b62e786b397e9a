"""gridmeter: power-system interval analytics as Spark DataFrame jobs.

Sub-packages:
  sources    readers and writers for interval files, solver result tables, templates
  functions  scalar Column expressions (clock, numeric, labels)
  operators  DataFrame -> DataFrame building blocks (reshape, windows, time series,
             statistics, typical periods, settlement)
  plans      end-user analysis queries composed from the operators
  streaming  the same interval aggregations over a file stream
"""

__version__ = "0.1.0"
