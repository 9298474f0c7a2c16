"""verdictflow: judging candidate pairs of claims as Spark jobs.

Every gate, metric and report is a ``DataFrame -> DataFrame`` function or a
``Column`` builder; nothing in this package loops over pairs on the driver.
"""

__version__ = "0.1.0"
