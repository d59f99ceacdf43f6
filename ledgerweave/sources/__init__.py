"""sources of ledgerweave."""
