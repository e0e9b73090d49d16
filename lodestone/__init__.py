"""lodestone: faceted search and analytics over flat tables, as DataFrame plans."""
