"""Training-data operators. Nothing else in docforge imports this subpackage."""
