"""rankloom: explainable hybrid ranking and data processing, expressed as Spark plans."""
