"""operators of ledgerweave."""
