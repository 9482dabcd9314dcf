"""docforge: document-text analytics expressed as Spark plans."""
