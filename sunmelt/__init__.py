"""Climate and material feature tables as Spark DataFrame operators."""
