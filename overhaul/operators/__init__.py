"""Shop operators: reports, listings, documents, lookups and change sets."""
