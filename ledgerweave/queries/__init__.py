"""queries of ledgerweave."""
