"""recordloom: record-oriented batch processing expressed as Spark DataFrame plans."""
