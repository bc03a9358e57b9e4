"""tally: receivables and sales-order reports as Spark DataFrame plans.

Entry points: ``tally.plans.reports`` (R1-R6 as functions),
``tally.plans.execute.execute`` (a report by name with a filters dict),
``tally.sources.tables`` (loading the ERP tables), ``tally.streaming``
(the ledger summary over a stream).
"""

__version__ = "0.1.0"
