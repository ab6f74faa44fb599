"""The table format: delta files, sorted runs, versioned manifests."""
