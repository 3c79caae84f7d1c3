"""foliomill: document-collection analytics expressed as PySpark DataFrame plans."""
