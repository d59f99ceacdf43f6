"""functions of ledgerweave."""
