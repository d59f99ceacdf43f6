"""streaming of ledgerweave."""
