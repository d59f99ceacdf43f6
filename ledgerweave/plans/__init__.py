"""plans of ledgerweave."""
