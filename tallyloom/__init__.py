"""tallyloom: reconciliation of paper-form readings with a ledger, on Spark.

The core (this package without ``llm``) reads forms and ledgers, matches them
by a prioritised key cascade, compares fields, classifies and reports.  The
optional subpackage ``llm`` holds operators for text and name data; nothing
outside it imports it.
"""

__version__ = "0.1.0"
