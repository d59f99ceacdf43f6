"""ledgerweave: transaction-risk analytics and data operators on PySpark."""
