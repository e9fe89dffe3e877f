"""Extension: keeping distances up to date while edges arrive. Not part of the batch engine's feature set."""
